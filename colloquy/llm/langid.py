"""Language identification with error-correcting output codes.

Every learned language gets a codeword; for each bit of it a binary logistic regression over hashed
byte n-grams (one to three bytes of the lower-cased letters) predicts that bit. Decoding sums, over
the bits, the logistic loss of each codeword's bit weighted by how well that bit's classifier
does on labelled rows kept from fitting, and takes the codeword with the least loss. The softmax of the negative
losses is the score; a text whose two best codewords are nearly tied is flagged ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: at most ``SAMPLE_ROWS`` documents,
an equal share for each language, chosen by a hash of ``doc_id``; their features are computed on the
executors from whole texts. Prediction covers every document and its whole text.

Defined cases: a null text or one without letters is ``und`` with score 0; with no labelled row at
all every text is ``und``; repeated rows get equal results; a null ``doc_id`` is never a training row;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import hold

DIMENSIONS = 1 << 13
SAMPLE_ROWS = 2000
ROUNDS = 150
#: Below this lead of the best over the second probability a decision is ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"
_BLOCK = 1 << 18
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of -1/+1 bits: all splits of up to 5 languages, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        columns = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1 << (n - 1), (1 << n) - 1)]
        return np.array(columns, np.float32).T
    bits, rng, best, most = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.integers(0, 2, (n, bits)) * 2 - 1
        gram = m @ m.T
        distance = ((bits - gram + 2 * bits * np.eye(n)) / 2).min()
        if distance > most and (abs(m.sum(0)) < n).all():
            best, most = m, distance
    return best.astype(np.float32)


def letters(text: str | None) -> bytes:
    """Lower-cased letters of a text in UTF-8, single blanks between words; empty if it has no letter."""
    if not text:
        return b""
    raw = text.encode("utf-8", "replace").translate(_FOLD)
    words = b" ".join(raw.split())
    if not words or (not any(97 <= c <= 122 for c in words) and not any(c.isalpha() for c in text)):
        return b""
    return b" " + words + b" "


def ngrams(block: np.ndarray) -> np.ndarray:
    """Hashed ids of all n-grams of one to three bytes that begin in a block of bytes."""
    x = block.astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    ids = np.concatenate([x * np.uint32(2654435761), (two + np.uint32(1 << 20)) * np.uint32(2654435761), (three + np.uint32(1 << 26)) * np.uint32(2654435761)])
    return ids >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def _blocks(data: bytes):
    x = np.frombuffer(data, np.uint8)
    for low in range(0, len(x), _BLOCK):
        yield x[low : low + _BLOCK + 2]


def features(text: str | None) -> np.ndarray | None:
    """Relative frequencies of the hashed n-grams of a whole text; None without letters."""
    data = letters(text)
    if not data:
        return None
    counts = np.zeros(DIMENSIONS)
    for block in _blocks(data):
        if len(block) >= 3:
            counts += np.bincount(ngrams(block), minlength=DIMENSIONS)
    return (counts / max(1.0, counts.sum())).astype(np.float32)


def _hold() -> None:
    """This module remembers nothing in a worker, and needs the room."""
    hold("langid", _nothing)


def _nothing() -> None:
    pass


def _feature_rows(batches):
    _hold()
    for b in batches:
        langs, rows = [], []
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = features(text)
            if x is not None:
                langs.append(lang)
                # few of the numbers are not 0, so what comes to the driver is small
                rows.append(zlib.compress(x.tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "x"])


def _matrix(rows: list[bytes]) -> np.ndarray:
    """The features of all drawn rows, of which no second copy is made."""
    out = np.empty((len(rows), DIMENSIONS), np.float32)
    for i, raw in enumerate(rows):
        out[i] = np.frombuffer(zlib.decompress(raw), np.float32)
    return out


class Model:
    """Languages, codewords, one linear classifier for each bit, and the bits' weights."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def margins(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for block in _blocks(data):
            if len(block) >= 3:
                ids = ngrams(block)
                total += self.weights[ids].sum(0)
                n += len(ids)
        return total / max(1, n) + self.bias

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        data = letters(text)
        if not data or not self.languages:
            return UNKNOWN, 0.0, True
        f = self.margins(data)
        losses = (np.logaddexp(0, -self.code * f) * self.trust).sum(1)
        p = np.exp(losses.min() - losses)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        lead = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)
        return self.languages[order[0]], float(p[order[0]]), bool(lead < AMBIGUOUS)


def fit(languages: list[str], x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regressions for all bits by full-batch gradient descent with momentum.

    Every fifth row is kept back, and each bit's weight is how well its classifier does on these.
    """
    code = codewords(len(languages))
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    held_x, held_y, x, y = (x[back], y[back], x[~back], y[~back]) if back.any() else (x, y, x, y)
    target = (code[y] + 1) / 2
    scale = np.float32(1.0) / np.maximum(np.sqrt((x**2).mean(0)), np.float32(1e-4))
    z = x * scale
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    step = 4.0 / max(1e-9, float((z**2).sum(1).mean()))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        g = (p - target) / len(z)
        vw = 0.9 * vw - step * (z.T @ g + 1e-4 * w)
        vb = 0.9 * vb - 0.05 * step * g.sum(0)
        w, b = w + vw, b + vb
    right = ((held_x * scale @ w + b > 0) == (code[held_y] > 0)).mean(0) if len(held_x) else np.ones(code.shape[1])
    trust = np.clip(2 * right - 1, 0.05, 1.0)
    return Model(languages, code, w * scale[:, None], b, trust)


def train(docs: DataFrame, rows: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows of ``docs`` (``doc_id``, ``text``, ``lang``) for which ``rows`` holds."""
    labelled = docs.where(rows & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))
    share = max(1, sample_rows // len(languages))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30))
    keep = F.lit(False)
    for lang, n in sizes.items():
        # a little more than the share, so that nearly always the whole share is drawn
        keep = keep | ((F.col("lang") == lang) & (draw < F.lit(min(1 << 30, int((share + 4 * share**0.5) / n * (1 << 30)) + 1))))
    drawn = labelled.where(keep).select("text", "lang").mapInArrow(_feature_rows, "lang string, x binary")
    seen = dict.fromkeys(languages, 0)
    x, y = [], []
    for r in drawn.toLocalIterator():
        if seen[r["lang"]] < share:
            seen[r["lang"]] += 1
            x.append(bytes(r["x"]))
            y.append(languages.index(r["lang"]))
    if not x:
        return Model([], np.ones((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))
    return fit(languages, _matrix(x), np.array(y))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang_pred: string, score: double, ambiguous: boolean>"

    @F.pandas_udf(kind)
    def decide(texts):
        import pandas as pd

        _hold()
        return pd.DataFrame([shared.value.decode(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), decide(F.col("text")).alias("said"))
    return out.select("row.*", "said.*")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
