"""Times reads of a transcript folder: python bench_transcripts.py FOLDER GB writes one of so many GB first, if it isn't there.

Prints one JSON line: seconds of an unscoped scan for a literal (no stored filters, the whole folder is looked
at), of one that finds its hits in the newest files, of one in an hour's window, of the stored filters and the
first scan with them, of building the stored index, and of a ranked phrase and a ranked common word from it.
"""

from __future__ import annotations

import json
import os
import random
import sys
import time
from concurrent.futures import ProcessPoolExecutor

from pyspark.sql import SparkSession

FILES, WORDS = 2400, 20_000
HOUR = 3_600_000
START = 1_704_067_200_000
_words: list[str] = []


def vocabulary() -> list[str]:
    if not _words:
        rng = random.Random(1)
        _words.extend("".join(rng.choices("etaoinshrdlu", k=3 + i % 7)) for i in range(WORDS))
    return _words


def write(args: tuple[str, int, int]) -> int:
    """One transcript of about ``size`` bytes, last changed when its last turn was said."""
    root, number, size = args
    rng, words = random.Random(number), vocabulary()
    folder = f"{root}/-w-project{number % 40}"
    os.makedirs(folder, exist_ok=True)
    done, turn = 0, 0
    with open(f"{folder}/s{number}.jsonl", "w") as f:
        while done < size:
            text = " ".join(words[int(rng.paretovariate(0.4)) % WORDS] for _ in range(rng.choice([10, 60, 400])))
            text += " the rare needle stands here" if number % 50 == 7 and turn % 500 == 3 else ""
            stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(START // 1000 + number * 3600 + turn))
            role = "user" if turn % 2 == 0 else "assistant"
            content = text if role == "user" else [{"type": "text", "text": text}, {"type": "tool_use", "name": "Run", "input": {"q": text[:200]}}]
            done += f.write(json.dumps({"type": role, "timestamp": stamp, "cwd": f"/w/project{number % 40}", "uuid": f"{number}-{turn}", "message": {"role": role, "content": content}}) + "\n")
            turn += 1
    at = START // 1000 + number * 3600 + turn
    os.utime(f"{folder}/s{number}.jsonl", (at, at))
    return done


def main() -> None:
    root, gb = sys.argv[1], float(sys.argv[2])
    if not os.path.isdir(root):
        with ProcessPoolExecutor(8) as pool:
            sum(pool.map(write, [(root, i, int(gb * 1e9 / FILES)) for i in range(FILES)], chunksize=20))
    from colloquy.operators import providers, store
    from colloquy.sources import descriptors, skipping

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", 64).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, out, place = descriptors.load()[0], {}, f"{root}-stored-{int(time.time())}"
    filters = skipping.Filters(spark, f"{place}/filters")

    def timed(name, f):
        began = time.time()
        more = f()
        out[name] = {"seconds": round(time.time() - began, 1)} | (more or {})

    def scan(query, scope, **more):
        p = providers.FolderScan.over(spark, {"claude_code": root}, known, "m1", **more)
        found, _ = providers.Retrieval(p).search(query, scope, limit=10_000 if "needle" in query else 20)
        return {"rows": found.count(), "files": p.files.count(), "opened": p.opened, "parsed": p.parsed}

    def built(library):
        p = providers.FolderScan.over(spark, {"claude_code": root}, known, "m1")
        library.write(p.turn_rows)
        return {"turns": library.snapshot().n}

    everything = providers.Scope(since=0)
    timed("start", lambda: scan("warm up needle", providers.Scope(since=START + 2_399 * HOUR)))
    timed("scan_rare", lambda: scan("rare needle", everything))
    timed("scan_common", lambda: scan(vocabulary()[3], everything))
    timed("scan_one_hour", lambda: scan("rare needle", providers.Scope(since=START + 2_357 * HOUR, until=START + 2_358 * HOUR)))
    timed("filters", lambda: {"read": filters.renew(providers.FolderScan.over(spark, {"claude_code": root}, known, "m1").files.select("path", "mtime", "size"))})
    timed("scan_rare_with_filters", lambda: scan("rare needle", everything, filters=filters))
    library = store.Library(spark, f"{place}/library")
    timed("index", lambda: built(library))
    index = library.snapshot().index()
    timed("ranked_phrase", lambda: {"rows": index.top_k(["rare", "needle"], 20).count()})
    common = vocabulary()[3]
    timed("ranked_common_word", lambda: {"rows": index.top_k([common], 20).count(), "blocks": index.blocks(common).count(), "read": index.needed(common, 20).count()})
    print(json.dumps({"metric": "transcripts", "gb": gb, "cpus": cpus, "results": out}))


if __name__ == "__main__":
    main()
