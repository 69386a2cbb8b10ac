"""Language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes; filters of several widths run over the window's bytes (a window's last places look
into the next one, so that no place is lost), each filter's highest answer in the window is kept, and a softmax over those answers
gives the window's languages. A document's language is that of the mean log-probabilities of all its windows, weighted by
their bytes. Letters A to Z count as a to z, and digits as one sign.

Training is by numpy on the driver, on a bounded sample of windows. In use the network is folded: what an embedding and a pair of a filter's
weights do to two neighbouring bytes is one row of a table, so a window is a few look-ups, shifts and sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.tokens import slices

WINDOW = 256
#: Filters are this wide; even widths, since places are looked up in pairs.
WIDTHS = (2, 4, 6)
_AHEAD = WIDTHS[-1] - 1
_SYMBOLS, _EMBEDDING, _FILTERS = 64, 8, 16
_BLOCK = 256 << 10
_WINDOWS_AT_ONCE = 64


def _symbols() -> np.ndarray:
    """Symbol of each byte: 0 is padding, 1 a blank, 2 a digit, 3 a sign, 4 and on the letters; bytes of longer characters share the rest."""
    kind = np.full(256, 3, np.uint8)
    kind[:33] = 1
    kind[ord("0") : ord("9") + 1] = 2
    for k in range(26):
        kind[[ord("a") + k, ord("A") + k]] = 4 + k
    kind[0x80:] = 30 + np.arange(128) % 34
    return kind


_SYMBOL = _symbols()


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of symbols, a row each with the ``_AHEAD`` places that follow it in the text, padded at its end; the text that each
    is of, and how many bytes of it. A text without bytes has one window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(1, -(-sizes // WINDOW))
    room = count * WINDOW + _AHEAD
    begins = np.cumsum(room) - room
    line = np.zeros(int(room.sum()), np.uint8)
    for text, at in zip(texts, begins, strict=True):
        line[at : at + len(text)] = _SYMBOL[np.frombuffer(text, np.uint8)]
    of = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    rows = line[(begins[of] + nth * WINDOW)[:, None] + np.arange(WINDOW + _AHEAD)]
    return rows, of, np.clip(sizes[of] - nth * WINDOW, 0, WINDOW)


@dataclass(frozen=True)
class Network:
    """Languages; the embedding of symbols, filters (width, embedding, filters) and their thresholds, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    thresholds: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """What each pair of symbols adds to each pair of places of each filter: 4096 rows."""
        parts = []
        for w in self.filters:
            for k in range(0, len(w), 2):
                one, two = self.embedding @ w[k], self.embedding @ w[k + 1]
                parts.append((one[:, None] + two[None]).reshape(-1, _FILTERS))
        return np.ascontiguousarray(np.concatenate(parts, axis=1), dtype=np.float32)

    def pooled(self, symbols: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The filters' highest answers in each window."""
        pairs = symbols[:, :-1].astype(np.intp) * _SYMBOLS + symbols[:, 1:]
        found = np.empty((len(symbols), len(WIDTHS) * _FILTERS), np.float32)
        for lo in range(0, len(symbols), _WINDOWS_AT_ONCE):
            answers, at = table[pairs[lo : lo + _WINDOWS_AT_ONCE]], 0
            for j, width in enumerate(WIDTHS):
                own = sum(answers[:, k : k + WINDOW, at + k // 2 * _FILTERS :][..., :_FILTERS] for k in range(0, width, 2))
                at += width // 2 * _FILTERS
                found[lo : lo + _WINDOWS_AT_ONCE, j * _FILTERS : (j + 1) * _FILTERS] = own.max(axis=1)
        return found

    def predict(self, texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the likeliest language of each text, and its probability."""
        symbols, of, size = windows(texts)
        logits = np.maximum(self.pooled(symbols, table) + self.thresholds, 0) @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, of, logs * size[:, None])
        mean = total / np.maximum(np.bincount(of, weights=size, minlength=len(texts)), 1)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(texts)), best]


def fit(samples: list[bytes], y: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the log-loss of windows, each language with the same weight. The gradient of a maximum goes to the place it was found at."""
    rng = np.random.default_rng(seed)
    classes = max(1, len(languages))
    p = {"E": rng.normal(0, 0.5, (_SYMBOLS, _EMBEDDING)), "t": np.zeros(len(WIDTHS) * _FILTERS), "O": rng.normal(0, 0.1, (len(WIDTHS) * _FILTERS, classes)), "o": np.zeros(classes)}
    p |= {f"W{w}": rng.normal(0, (w * _EMBEDDING) ** -0.5, (w, _EMBEDDING, _FILTERS)) for w in WIDTHS}
    made = lambda: Network(languages, p["E"], [p[f"W{w}"] for w in WIDTHS], p["t"], p["O"], p["o"])
    if len(languages) < 2 or not samples:
        return made()
    weight = len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1))
    symbols = np.zeros((len(samples), WINDOW + _AHEAD), np.uint8)
    for row, text in zip(symbols, samples, strict=True):
        row[: len(text)] = _SYMBOL[np.frombuffer(text[: WINDOW + _AHEAD], np.uint8)]
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(samples) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            x, n = symbols[some], len(some)
            e = p["E"][x]
            pooled, places = [], []
            for w in WIDTHS:
                seen = np.lib.stride_tricks.sliding_window_view(e[:, : WINDOW + w - 1], w, axis=1)  # n, places, embedding, width
                answers = seen.transpose(0, 1, 3, 2).reshape(n * WINDOW, -1) @ p[f"W{w}"].reshape(-1, _FILTERS)
                answers = answers.reshape(n, WINDOW, _FILTERS)
                places.append(answers.argmax(axis=1))
                pooled.append(np.take_along_axis(answers, places[-1][:, None], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1) + p["t"]
            h = np.maximum(z, 0)
            logits = h @ p["O"] + p["o"]
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            d = share
            d[np.arange(n), y[some]] -= 1
            d *= (weight[y[some]] / n)[:, None]
            g = {"O": h.T @ d, "o": d.sum(axis=0), "E": np.zeros_like(p["E"])}
            dz = (d @ p["O"].T) * (z > 0)
            g["t"] = dz.sum(axis=0)
            for j, w in enumerate(WIDTHS):
                dj = dz[:, j * _FILTERS : (j + 1) * _FILTERS]
                at = places[j][:, :, None] + np.arange(w)  # n, filters, width
                own = x[np.arange(n)[:, None, None], at]
                g[f"W{w}"] = np.einsum("nf,nfwe->wef", dj, p["E"][own], optimize=True)
                back = np.einsum("nf,wef->nfwe", dj, p[f"W{w}"], optimize=True)
                for c in range(_EMBEDDING):
                    g["E"][:, c] += np.bincount(own.ravel(), weights=back[..., c].ravel(), minlength=_SYMBOLS)
            step += 1
            now = rate * (1 - step / (total + 1))
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return made()


def held_out(id_column: Column) -> Column:
    """True where the CRC-32 of the id as text leaves 1 on division by 3; a null id is '' here."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _first_of_each(rows: DataFrame, key: str, order: list[str], most: int, ways: int = 128) -> DataFrame:
    """The first ``most`` rows of each key, in two steps: no task reads more than ``ways * most`` rows of a key in the second."""
    for dealt in ([key, F.spark_partition_id() % ways], [key]):
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*dealt).orderBy(*order))).where(F.col("__n") <= most)
        rows = rows.drop("__n")
    return rows


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_documents: int = 2400, max_windows: int = 4) -> Network:
    """Learns from rows that aren't held out and whose text and language aren't null.

    The sample's bounds: ``max_documents`` rows, as many of each language (those of least hash of the id), and of each row
    ``max_windows`` windows spread evenly over the whole text. No more than their bytes reach the driver, whatever the texts' lengths and
    however often an id is repeated. Every language there is gets learned, if ``max_documents`` has a row for each.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(text_col).cast("string").alias("t"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(max_documents).collect())
    each = max(1, max_documents // max(1, len(languages)))
    # first the hashes alone, which set the highest of each language's sample; then the texts of those
    bounds = _first_of_each(rows.select("lang", "h"), "lang", ["h"], each).groupBy(F.col("lang").alias("own")).agg(F.max("h").alias("most"))
    near = rows.join(F.broadcast(bounds.limit(max_documents)), (F.col("lang") == F.col("own")) & (F.col("h") <= F.col("most"))).select("lang", "h", "t")
    size = WINDOW + _AHEAD

    def cut(it):
        for batch in it:
            for part in slices(batch, 2):
                samples = []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    n = min(max_windows, -(-max(1, len(text)) // WINDOW))
                    samples.append([text[at : at + size] for at in (k * max(0, len(text) - WINDOW) // max(1, n - 1) for k in range(n))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(samples, pa.list_(pa.binary()))], names=["lang", "h", "samples"])

    sampled = near.mapInArrow(cut, "lang string, h long, samples array<binary>")
    got = _first_of_each(sampled, "lang", ["h", "samples"], each).collect()
    got.sort(key=lambda r: (r["lang"], r["h"], r["samples"]))
    place = {lang: k for k, lang in enumerate(languages)}
    samples = [(bytes(s), place[r["lang"]]) for r in got for s in r["samples"] if s]
    return fit([s for s, _ in samples], np.array([k for _, k in samples], np.int64), languages)


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, lang_pred and score, the predicted language's probability.

    Every byte of a text is read. A null text or one without a letter is ``und`` with score 0, as is every text if no language was
    learned. Repeated rows and null ids are predicted like all others; equal probabilities go to the language that sorts first. An empty
    table gives no rows. No other column of ``docs``, whatever its name, is read.
    """
    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), letters.alias("letters"), F.col(text_col).cast("string").alias("t"))

    def predict(it):
        table = network.table()
        names = np.array([*network.languages, "und"], dtype=object)
        for batch in it:
            for part in slices(batch, 2, _BLOCK):
                some = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                if not network.languages:
                    some[:] = False
                best, score = np.full(len(some), len(names) - 1), np.zeros(len(some))
                if some.any():
                    best[some], score[some] = network.predict(part.column(2).filter(pa.array(some)).cast(pa.binary()).to_pylist(), table)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
