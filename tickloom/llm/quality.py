"""Quality classifier: gated attention over the passages of a document (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.labelled import fold, learning_rows
from tickloom.llm.registry import query, table
from tickloom.llm.wordhash import portions, hash_words, text_buffer, word_places

SAMPLE = 4_000  # labelled documents learned from, at most
PASSAGE = 40  # words of a passage; the last of a text may be shorter
MOST_PASSAGES = 2_000  # of a longer labelled document so many passages, evenly spread, are learned from
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 150, 0.03, 1e-4
THRESHOLD = 0.3
REPEATS = (1, 2, 3, 5, 8)  # distances, in words, at which a repeated word is looked for


def _classes() -> np.ndarray:
    kinds = np.zeros((7, 256), np.int32)
    kinds[0, 65:91] = 1  # capitals
    kinds[1, 97:123] = 1  # small letters
    kinds[2, 48:58] = 1  # digits
    kinds[3, [ord(c) for c in ".,;:?"]] = 1  # punctuation
    kinds[4, [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:?"]] = 1  # other signs
    kinds[5, 128:] = 1  # bytes of other letters
    kinds[6, 10] = 1  # line ends
    return kinds


_KINDS = _classes()
FEATURES = 16 + len(REPEATS)


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Encoding of every passage of every text, and n + 1 offsets.  Each text has one passage at least."""
    data, offsets = text_buffer(column)
    start, end, first = word_places(data, offsets)
    n = len(column)
    counts = np.maximum(-(-np.diff(first) // PASSAGE), 1)
    where = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((where[-1], FEATURES))
    if not len(start):
        return out, where
    hashes = hash_words(data, start, end)
    owner = np.repeat(np.arange(n), np.diff(first))
    place = np.arange(len(start)) - first[owner]
    passage = where[owner] + place // PASSAGE
    size = np.bincount(passage, minlength=len(out)).astype(float)
    per = np.maximum(size, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, len(out)) / per

    length = (end - start).astype(float)
    count = np.empty((7, len(start)), np.int32)
    for kind in range(7):
        total = np.concatenate([[0], np.cumsum(_KINDS[kind][data], dtype=np.int32)])
        count[kind] = total[end] - total[start]
        if kind == 6:  # line ends lie between the words
            after = np.append(start[1:], len(data))
            count[kind] = total[after] - total[end]
    columns = [np.log1p(size), mean(length) / 10, np.sqrt(mean(length ** 2)) / 10]
    columns += [mean(count[kind] / length) for kind in range(6)] + [mean(np.minimum(count[6], 2))]
    columns.append(mean(((count[0] > 1) & (count[1] == 0)).astype(float)))  # words in capitals
    columns.append(mean(((count[0] + count[1] + count[5]) == 0).astype(float)))  # words without letters
    columns.append(mean((count[4] > 0).astype(float)))

    def fresh(group: np.ndarray) -> np.ndarray:
        keys = hashes + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        new = np.zeros(len(keys))
        new[np.unique(keys, return_index=True)[1]] = 1
        return mean(new)

    columns += [fresh(passage), fresh(owner), np.log1p(np.bincount(owner, minlength=n))[np.repeat(np.arange(n), counts)]]
    for back in REPEATS:
        same = np.zeros(len(start))
        same[back:] = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        columns.append(mean(same))
    return np.stack(columns, axis=1), where


class Attention:
    """h = tanh(x W + c); attention a ~ softmax(q . (tanh(h V) * sigmoid(h U))); log-odds = sum(a h) . o + b."""

    SHAPES = {"W": (FEATURES, HIDDEN), "c": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "q": (GATE,),
              "o": (HIDDEN,), "b": ()}

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(1)
        self.mean, self.scale = mean, scale
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s) for k, s in self.SHAPES.items()}
        self.p["q"], self.p["o"] = rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, HIDDEN)

    def forward(self, x: np.ndarray, where: np.ndarray) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        s = (t * g) @ p["q"]
        bag = np.repeat(np.arange(len(where) - 1), np.diff(where))
        e = np.exp(s - np.maximum.reduceat(s, where[:-1])[bag])
        a = e / np.add.reduceat(e, where[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, where[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "odds": z @ p["o"] + p["b"]}

    def score(self, x: np.ndarray, where: np.ndarray) -> np.ndarray:
        if len(where) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, where)["odds"], -30, 30)))

    def fit(self, x: np.ndarray, where: np.ndarray, labels: np.ndarray) -> None:
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.p["b"] = np.array(np.log(share / (1 - share)))
        m = {k: np.zeros(s) for k, s in self.SHAPES.items()}
        v = {k: np.zeros(s) for k, s in self.SHAPES.items()}
        for step in range(1, STEPS + 1):
            grads = self.gradients(self.forward(x, where), where, labels)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                rate = RATE * (1 - (step - 1) / STEPS)
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)

    def gradients(self, f: dict, where: np.ndarray, labels: np.ndarray) -> dict:
        p, bag, a, h = self.p, f["bag"], f["a"], f["h"]
        d = (1 / (1 + np.exp(-np.clip(f["odds"], -30, 30))) - labels) / len(labels)
        dz = d[:, None] * p["o"]
        da = (dz[bag] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, where[:-1])[bag])
        dt, dg = ds[:, None] * p["q"] * f["g"], ds[:, None] * p["q"] * f["t"]
        dpt, dpg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = a[:, None] * dz[bag] + dpt @ p["V"].T + dpg @ p["U"].T
        dpre = dh * (1 - h ** 2)
        out = {"W": f["x"].T @ dpre, "c": dpre.sum(axis=0), "V": h.T @ dpt, "U": h.T @ dpg,
               "q": (f["t"] * f["g"]).T @ ds, "o": f["z"].T @ d, "b": d.sum()}
        return {k: g + DECAY * p[k] if k in "WVUqo" else g for k, g in out.items()}


def train(rows: DataFrame) -> Attention:
    """Fit on (text, label) rows, a bounded sample, whose passages are encoded by the executors."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, 0)):
            x, where = passages(batch.column(0))
            kept = [a + np.arange(k) * n // k for a, n in zip(where, np.diff(where)) for k in [min(n, MOST_PASSAGES)]]
            x, where = x[np.concatenate(kept)], np.append(0, np.cumsum([len(k) for k in kept]))
            flat = pa.ListArray.from_arrays(pa.array((where * FEATURES).astype(np.int32)),
                                            pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), flat], names=["label", "passages"])

    got = (rows.select("text", "label").mapInArrow(encode, "label int, passages array<float>").toArrow().combine_chunks())
    labels = got.column("label").to_numpy().astype(float)
    lists = got.column("passages").chunks
    flat = np.concatenate([c.flatten().to_numpy() for c in lists] or [np.zeros(0)]).astype(float).reshape(-1, FEATURES)
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists] or [np.zeros(0, int)]) // FEATURES
    where = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not len(labels):
        return Attention(np.zeros(FEATURES), np.ones(FEATURES))
    model = Attention(flat.mean(axis=0), flat.std(axis=0) + 1e-3)
    model.fit(flat, where, labels)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE,
                   threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) for every row of ``docs``.

    Every passage of every whole text is encoded from its own words: shares of letters, signs, capitals and line ends,
    repeats at several distances, new words.  Document labels train the encoder, the gated attention and the output
    together, on a hash sample of at most ``sample`` labelled documents outside the held-out fold.

    Null, empty and blank texts have one empty passage and are scored like any other; rows with a null doc_id are
    in no fold and not held out; repeated rows each keep a row; without labels the model is untrained but scores all the
    same; an empty table gives an empty result.  Label 1 is good.
    """
    at = fold(F.col("doc_id"), folds)
    model = docs.sparkSession.sparkContext.broadcast(train(learning_rows(docs, labels, "quality", at != held, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b)):
            x, where = passages(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.value.score(x, where)), pa.array(np.diff(where))],
                names=["doc_id", "score", "n_passages"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, n_passages long")
    return scored.select("doc_id", F.coalesce(at == held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


@query("op1_quality_mil")
def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
