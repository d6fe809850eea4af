from pathlib import Path

import numpy as np
import pytest

from colloquy.llm import words


def resident() -> int:
    """Kilobytes of this process that are its own."""
    return int(Path("/proc/self/smaps_rollup").read_text().split("Pss_Anon:")[1].split()[0])


@pytest.mark.skipif(words._TRIM is None or not Path("/proc/self/smaps_rollup").exists(), reason="needs glibc and Linux")
def test_memory_of_another_operator_goes_back_to_the_system(monkeypatch):
    monkeypatch.setattr(words, "_HELD", {})
    held: dict = {}
    words.hold("one", held.clear)
    # small blocks between which some stay, so that the heap can't shrink from its end
    held["blocks"] = [np.ones(12_000, np.uint8) for _ in range(8_000)]
    stay = held["blocks"][::50]
    before = resident()
    words.hold("two", dict)
    assert not held and before - resident() > 60_000 and len(stay) == 160


def test_what_an_operator_holds_stays_while_it_runs(monkeypatch):
    monkeypatch.setattr(words, "_HELD", {})
    held = {"a": 1}
    for _ in range(2):
        words.hold("one", held.clear)
    assert held
    words.hold("two", dict)
    assert not held
