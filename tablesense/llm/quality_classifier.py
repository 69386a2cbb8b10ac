"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded as a vector of shares (kinds of
characters, word lengths, repetition, hashed letter pairs), which a tanh layer takes to an embedding h. Gated attention gives
each passage a weight, softmax of ``w . (tanh(V h) * sigmoid(U h))`` over the bag; the weighted sum of the embeddings is the
document's representation, from which a logistic unit gives the score. Labels are the documents'; the weights of
passages are learned with the rest (Ilse, Tomczak and Welling, 2018).

The model is a few thousand numbers. It is fitted on the driver on a bounded sample of labelled documents; every
document is scored, in one pass that moves no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.llm.shared import text_key
from tablesense.llm.tokens import slices

PASSAGE_WORDS = 64
_PAIRS = 64
_BLOCK = 512 << 10
#: A passage has no more bytes than this, so that a text without blanks is encoded in parts too.
_MOST_BYTES = 4096


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 small letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 full stop or comma, 6 ! or ?,
    7 symbol, 8 other sign, 9 first byte of a longer character, 10 a byte that follows."""
    kind = np.full(256, 8, np.uint8)
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:", 5), (b"!?", 6), (b"#*$%&|<>~^=+_@{}[]\\/", 7)):
        kind[list(chars)] = k
    kind[0x80:0xC0], kind[0xC0:] = 10, 9
    return kind


_KIND = _kinds()
_KINDS, _LENGTHS = 11, (2, 4, 7, 11, 16)
#: Columns of an encoded passage.
FEATURES = _KINDS + len(_LENGTHS) + 1 + 5 + _PAIRS


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the passages of some texts, and which text each is of. A text without words is one passage of blanks."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    kind = _KIND[data]
    blank = (kind == 3) | (kind == 4)
    first = ~blank
    first[1:] &= blank[:-1]
    words = np.flatnonzero(first)  # where words begin; texts are parted by a blank
    text_of_word = np.searchsorted(ends, words, side="right")
    nth = np.arange(len(words)) - np.searchsorted(words, begins)[text_of_word]
    cuts = np.unique(np.concatenate([begins, words[(nth % PASSAGE_WORDS == 0) & (nth > 0)]]))
    sizes = np.diff(np.append(cuts, len(data)))
    if (sizes > _MOST_BYTES).any():
        cuts = np.concatenate([np.arange(a, a + n, _MOST_BYTES) for a, n in zip(cuts, sizes)])
    bag = np.searchsorted(ends, cuts, side="right")
    n = len(cuts)
    passage = np.repeat(np.arange(n), np.diff(np.append(cuts, len(data))))
    x = np.zeros((n, FEATURES), np.float32)
    x[:, :_KINDS] = np.bincount(passage * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    size = np.maximum(x[:, :_KINDS].sum(axis=1, keepdims=True), 1)
    x[:, :_KINDS] /= size

    if len(words):
        last = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
        length, of = last - words, passage[words]
        n_words = np.bincount(of, minlength=n).astype(np.float32)
        per_word = np.maximum(n_words, 1)[:, None]
        bins = np.digitize(length, _LENGTHS)
        at = _KINDS
        width = len(_LENGTHS) + 1
        x[:, at : at + width] = np.bincount(of * width + bins, minlength=n * width).reshape(n, width) / per_word
        at += width
        # a word's identity: a sum of its bytes' codes times odd powers of their places
        begun = np.zeros(len(data), np.int64)
        begun[words] = words
        place = np.arange(len(data)) - np.maximum.accumulate(begun)
        codes = (data.astype(np.uint64) | np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        codes = (codes ^ (codes >> np.uint64(32))) * (np.uint64(2) * (place.astype(np.uint64) & np.uint64(31)) + np.uint64(0xBF58476D1CE4E5B9))
        codes[blank] = 0
        ids = np.add.reduceat(codes, words)
        order = np.lexsort((ids, of))
        same = np.concatenate([[False], (ids[order][1:] == ids[order][:-1]) & (of[order][1:] == of[order][:-1])])
        runs = np.flatnonzero(~same)
        counts, owner = np.diff(np.append(runs, len(ids))), of[order][runs]
        most = np.zeros(n)
        np.maximum.at(most, owner, counts)
        distinct = np.bincount(owner, minlength=n)
        x[:, at] = distinct / per_word[:, 0]
        x[:, at + 1] = most / per_word[:, 0]
        x[:, at + 2] = np.log1p(n_words) / 5
        x[:, at + 3] = np.bincount(of, weights=length, minlength=n) / per_word[:, 0] / 10
        # words that stood in this text before, in this passage or an earlier one
        order = np.lexsort((words, ids, text_of_word))
        again = np.concatenate([[False], (ids[order][1:] == ids[order][:-1]) & (text_of_word[order][1:] == text_of_word[order][:-1])])
        x[:, at + 4] = np.bincount(of[order], weights=again, minlength=n) / per_word[:, 0]
    low = data | np.where(kind == 1, 32, 0).astype(np.uint8)
    pair = ((low[:-1].astype(np.uint32) * 0x9E3779B1 + low[1:].astype(np.uint32) * 0x85EBCA77) >> 20) % _PAIRS
    own = np.ones(len(pair), bool)
    own[ends[:-1] - 1] = False  # a blank between two texts and the first letter of the next are no pair
    hashed = np.bincount((passage[:-1] * _PAIRS + pair)[own], minlength=n * _PAIRS).reshape(n, _PAIRS)
    x[:, -_PAIRS:] = np.sqrt(hashed / size)
    return x, bag


@dataclass(frozen=True)
class Model:
    """Scaling of the vectors, and the layers: embedding (E, e), attention (V, U, w) and the score's unit (c, b)."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple[np.ndarray, dict]:
        """Log-odds of n bags, whose passages stand together in order; and what the gradient needs."""
        p = self.layers
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        starts = np.searchsorted(bag, np.arange(n))
        a = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        m = np.add.reduceat(a[:, None] * h, starts)
        return m @ p["c"] + p["b"], {"z": z, "h": h, "v": v, "u": u, "a": a, "m": m, "starts": starts}

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, bag = encode_passages(texts)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.bags(x, bag, len(texts))[0].astype(np.float64)))


def _gradient(model: Model, x, bag, y, weight, decay: float) -> dict[str, np.ndarray]:
    p, n = model.layers, len(y)
    logit, k = model.bags(x, bag, n)
    d = (1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()
    g = {"c": k["m"].T @ d, "b": d.sum(keepdims=True)}
    dm = (d[:, None] * p["c"])[bag]
    da = (dm * k["h"]).sum(axis=1)
    ds = k["a"] * (da - np.add.reduceat(k["a"] * da, k["starts"])[bag])
    g["w"] = (k["v"] * k["u"]).T @ ds
    dvu = ds[:, None] * p["w"]
    dv, du = dvu * k["u"] * (1 - k["v"] ** 2), dvu * k["v"] * k["u"] * (1 - k["u"])
    g["V"], g["U"] = k["h"].T @ dv, k["h"].T @ du
    dh = (dm * k["a"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - k["h"] ** 2)
    g["E"], g["e"] = k["z"].T @ dh, dh.sum(axis=0)
    return {name: g[name] + (decay * p[name] if p[name].ndim == 2 else 0) for name in p}


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the weighted log-loss. Without bags, or with one label only, the score is that label's share everywhere."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    shape = {"E": (FEATURES, hidden), "V": (hidden, attention), "U": (hidden, attention)}
    layers = {k: rng.normal(0, s[0] ** -0.5, s) for k, s in shape.items()} | {"e": np.zeros(hidden), "w": rng.normal(0, 0.1, attention), "c": np.zeros(hidden)}
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    layers["b"] = np.array([np.log(share / (1 - share))])
    model = Model(every.mean(axis=0), np.maximum(every.std(axis=0), 1e-2), layers)
    if len(set(y.tolist())) < 2:
        return model
    first, second = ({k: np.zeros_like(v) for k, v in layers.items()} for _ in range(2))
    step = 0
    total = epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            x = np.concatenate([bags[i] for i in some])
            bag = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in _gradient(model, x, bag, y[some], weight[some], decay).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_column: Column) -> Column:
    """True where the CRC-32 of the id as text leaves 0 on division by 5; a null id is '' here."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_documents: int = 6000, max_bytes: int = 64 << 20) -> Model:
    """Fits on rows that aren't held out: at most ``max_documents`` of them, as many of each label as there are up to half, those of
    least hash of their id, and of these the first whose texts have ``max_bytes`` together (the sample's two bounds; a label's rows
    weigh as much as all its rows do). All passages of their texts are learned from: a text that doesn't fit is left out, not cut.

    A document with several labels has their mean, rounded half up; null labels are none. Of rows with one id, that of least
    digest of its text is the one learned from.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    mixed = F.xxhash64(F.col(id_col).cast("string"))
    half = max_documents // 2
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    wanted = [known.where(F.col("y") == k).orderBy(mixed, id_col).limit(max(half, max_documents - sizes.get(1 - k, 0))) for k in (0, 1)]
    sample = wanted[0].union(wanted[1]).select(F.col(id_col).alias("__id"), "y")
    texts = docs.select(F.col(id_col).alias("__own"), F.col(text_col).cast("string").alias("t"))
    rows = texts.join(F.broadcast(sample), F.col("__own") == F.col("__id")).select(F.col("__id").cast("string").alias("id"), "y", "t")
    size = F.coalesce(F.octet_length("t"), F.lit(0))
    one = rows.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(text_key(F.col("t")).alias("key"), size.alias("bytes"))).alias("least"))
    room, taken = max_bytes, []
    for r in sorted(one.select("id", "y", "least.key", "least.bytes", F.xxhash64("id").alias("h")).collect(), key=lambda r: (r["h"], r["id"])):  # ``max_documents`` rows
        if r["bytes"] <= room:
            room -= r["bytes"]
            taken.append((r["id"], r["key"]))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "__id string, __key binary"))
    rows = rows.join(chosen, (F.col("id") == F.col("__id")) & (text_key(F.col("t")) == F.col("__key"))).groupBy("id").agg(F.first("y").alias("y"), F.first("t").alias("t"))

    def encode(it):
        for b in it:
            for part in slices(b, 2, _BLOCK):
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                x, bag = encode_passages(texts)
                out = [x[bag == k].tobytes() for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["id", "y", "x"])

    got = sorted(rows.mapInArrow(encode, "id string, y int, x binary").collect(), key=lambda r: (r["id"], bytes(r["x"])))
    y = np.array([r["y"] for r in got], dtype=float)
    share = np.array([sizes.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    return fit([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got], y, share[y.astype(int)] if len(y) else np.zeros(0))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score (0 to 1), predicted (1 if score >= ``threshold``, else 0).

    Null, empty and blank texts are one passage without words and are scored as such. Repeated rows and null ids are
    scored like all others. An empty table gives no rows. Texts may be of any length; no other column of ``docs``, whatever its
    name, is read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def score(it):
        for b in it:
            for part in slices(b, 1, _BLOCK):
                got = model.score([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], names=["id", "score"])

    scored = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores below ``threshold``. All columns stay as they are; an empty table
    stays empty."""
    schema = docs.schema

    def keep(it):
        for b in it:
            at = b.schema.get_field_index(text_col)
            for part in slices(b, at, _BLOCK):
                got = model.score([t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array(got >= threshold))

    return docs.mapInArrow(keep, schema)
