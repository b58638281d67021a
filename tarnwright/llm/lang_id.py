"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, each with a gated recurrent unit, and labels every byte
position with a distribution over the languages. A document's probabilities are the mean of those of its letters'
positions (ASCII letters, and all bytes beyond ASCII); the largest wins, ties go to the smaller language name.
Training is backpropagation through time, in numpy. A to Z are lower-cased before, as case says nothing about the
language.

States are carried along the whole text, over spaces and signs. So that many texts advance together and no length
matters, a text is read in stretches of STRETCH bytes; each direction starts CONTEXT bytes before the stretch, where
no label counts. Training bounds what a state keeps and how strongly it enters the next, so states forget where they
began within that: a text's probabilities are those of reading it in one go to better than 1e-5 (tested). All
stretches of a batch are lanes of one array, the longest first, so that those still being read are always its head
and nothing is padded.

Training rows are pieces of SEGMENT characters, from anywhere in the texts of documents that are not held out, have
text and a language: a sample by hash, about MOST_SEGMENTS, as many for each language (what bounds the driver's work
is this parameter alone; no text is too long to be drawn from). Prediction covers every letter of every text.

Defined results: `und` with score 0 for null and empty texts, texts without a letter, and all texts where nothing
could be learned. One learned language gives that language and score 1. Scores are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, map_batches, ship, utf8

FOLDS = 5
MOST_SEGMENTS, SEGMENT = 4096, 160
HIDDEN = 16
#: The most of a state that one step keeps: what began long ago is forgotten, so that a stretch needs little context.
MOST_KEPT = 0.9
#: The greatest norm of each matrix by which a state enters the next.
MOST_NORM = 0.8
ROUNDS, BATCH, RATE = 5, 256, 0.02
STRETCH, CONTEXT = 1024, 64
#: Lanes that advance together, and bytes of texts whose lanes are made together.
LANES, PART_BYTES = 512, 1 << 21

LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_COUNTED = _ASCII_LETTER | (np.arange(256) >= 128)


@dataclass
class Network:
    """Weights by direction: wx (256 x 3H), wh (H x 3H), b (3H), of gates z, r and the candidate; wo (2H x langs), bo."""

    langs: list[str]
    weights: dict[str, np.ndarray]


def _start(langs: list[str], rng: np.random.Generator) -> Network:
    w = {}
    for d in "fb":
        w[f"wx{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        w[f"wh{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
        w[f"b{d}"] = np.zeros(3 * HIDDEN)
    w["wo"], w["bo"] = rng.normal(0, 0.2, (2 * HIDDEN, len(langs))), np.zeros(len(langs))
    return Network(langs, {k: v.astype(np.float32) for k, v in w.items()})


def _lanes(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by time and lane, and how many lanes are live at each time; lanes are sorted by falling length."""
    time = np.arange(int(length[0]))
    x = text[np.minimum(start + time[:, None], len(text) - 1)].astype(np.intp)
    return x, np.searchsorted(-length, -time)


def _order(live: np.ndarray, direction: str) -> range:
    return range(len(live)) if direction == "f" else range(len(live) - 1, -1, -1)


def _states(w: dict[str, np.ndarray], d: str, x: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The states of the live lanes, time by time; d is f or b. An array that is given is good until the next one.

    sigmoid(x) is (1 + tanh(x / 2)) / 2, so weights of z and r are halved here, and r's other half is in the candidate's.
    """
    parts = [slice(i * HIDDEN, (i + 1) * HIDDEN) for i in range(3)]
    byte = [np.ascontiguousarray(s * (w[f"wx{d}"] + w[f"b{d}"])[:, p]) for s, p in zip((0.5, 0.5, 1.0), parts, strict=True)]
    state = [np.ascontiguousarray(0.5 * w[f"wh{d}"][:, p]) for p in parts]
    h, z, r, c, s = (np.zeros((x.shape[1], HIDDEN), byte[0].dtype) for _ in range(5))
    for t in _order(live, d):
        k = live[t]
        hk, sk, ck, at = h[:k], s[:k], c[:k], x[t, :k]
        for i, gate in ((0, z[:k]), (1, r[:k])):
            np.matmul(hk, state[i], out=gate)
            np.take(byte[i], at, axis=0, out=sk, mode="clip")
            gate += sk
            np.tanh(gate, out=gate)
        np.matmul(hk, state[2], out=ck)
        r[:k] += 1
        ck *= r[:k]
        np.take(byte[2], at, axis=0, out=sk, mode="clip")
        ck += sk
        np.tanh(ck, out=ck)
        z[:k] += 1
        z[:k] *= 0.5 * MOST_KEPT
        np.subtract(hk, ck, out=hk)  # h = z h + (1 - z) c
        hk *= z[:k]
        hk += ck
        yield t, hk


def _labels(net: Network, x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Probabilities by language, time and lane; without meaning where a lane is not live."""
    w = net.weights
    p = np.zeros((len(net.langs), *x.shape), w["wo"].dtype)
    p += w["bo"][:, None, None]
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        out = np.ascontiguousarray(w["wo"][part].T)
        for t, h in _states(w, d, x, live):
            p[:, t, : len(h)] += out @ h.T
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p


def _gradient(net: Network, x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over weighted positions (time by lane), back through time in both directions."""
    w, kept = net.weights, {"f": [], "b": []}
    states = np.zeros((*x.shape, 2 * HIDDEN), w["wo"].dtype)
    halves = (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None)))
    for d, part in halves:
        state = np.zeros((x.shape[1], HIDDEN), w["wo"].dtype)
        for t in _order(live, d):
            k = live[t]
            h = state[:k].copy()
            xin, hin = w[f"wx{d}"][x[t, :k]] + w[f"b{d}"], h @ w[f"wh{d}"]
            gates = 1 / (1 + np.exp(-xin[:, : 2 * HIDDEN] - hin[:, : 2 * HIDDEN]))
            z, r = MOST_KEPT * gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(xin[:, 2 * HIDDEN :] + r * hin[:, 2 * HIDDEN :])
            kept[d].append((t, h, z, r, c, hin[:, 2 * HIDDEN :]))
            state[:k] = z * h + (1 - z) * c
            states[t, :k, part] = state[:k]
    score = states @ w["wo"] + w["bo"]
    p = np.exp(score - score.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(len(y)), y] -= 1
    p *= (weight / max(1, weight.sum()))[:, :, None]
    g = {"wo": np.einsum("tnh,tnk->hk", states, p), "bo": p.sum(axis=(0, 1))}
    back = p @ w["wo"].T
    by_byte = np.argsort(x, axis=None, kind="stable")
    first = np.flatnonzero(np.diff(x.ravel()[by_byte], prepend=-1))
    for d, part in halves:
        gh, dx = np.zeros_like(w[f"wh{d}"]), np.zeros((*x.shape, 3 * HIDDEN), w["wo"].dtype)
        dh = np.zeros((x.shape[1], HIDDEN), w["wo"].dtype)
        for t, h, z, r, c, hc in reversed(kept[d]):
            k = len(h)
            dn = dh[:k] + back[t, :k, part]
            dc = dn * (1 - z) * (1 - c * c)
            dz, dr = dn * (h - c) * z * (1 - z / MOST_KEPT), dc * hc * r * (1 - r)
            dx[t, :k] = np.concatenate([dz, dr, dc], axis=1)
            dhin = np.concatenate([dz, dr, dc * r], axis=1)
            gh += h.T @ dhin
            dh[:k] = dn * z + dhin @ w[f"wh{d}"].T
        flat, gx = dx.reshape(-1, 3 * HIDDEN), np.zeros_like(w[f"wx{d}"])
        gx[x.ravel()[by_byte[first]]] = np.add.reduceat(flat[by_byte], first, axis=0)
        g |= {f"wx{d}": gx, f"wh{d}": gh, f"b{d}": flat.sum(axis=0)}
    return g


def train(rows: list[tuple[str, str]], seed: int = 7) -> Network | None:
    """A network from (text, language) rows; None without any letter to learn from."""
    data = [(b, lang) for text, lang in rows if LETTER.search(text) and (b := text.encode().lower())]
    langs = sorted({lang for _, lang in data})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    net = _start(langs, rng)
    if len(langs) == 1:
        return net
    label = np.array([langs.index(lang) for _, lang in data])
    text = np.frombuffer(b"".join(b for b, _ in data), np.uint8)
    length = np.fromiter((len(b) for b, _ in data), np.int64, len(data))
    start = np.cumsum(length) - length
    share = 1 / np.bincount(label, minlength=len(langs))[label]  # each language as often as any other
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    total = ROUNDS * -(-len(data) // BATCH)
    for step in range(1, total + 1):
        some = rng.choice(len(data), BATCH, p=share / share.sum())
        some = some[np.argsort(-length[some], kind="stable")]
        x, live = _lanes(text, start[some], length[some])
        weight = (_COUNTED[x] & (np.arange(BATCH) < live[:, None])).astype(np.float32)
        g = _gradient(net, x, live, label[some], weight)
        rate = RATE * (1 - step / (total + 1))
        for k, v in g.items():  # Adam
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.01 * (v * v - square[k])
            net.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        for k in ("whf", "whb"):
            for part in np.split(net.weights[k], 3, axis=1):  # views
                part *= min(1.0, MOST_NORM / max(1e-9, np.linalg.norm(part, 2)))
    return net


def _sums(net: Network, raw: list[bytes]) -> np.ndarray:
    """Of each text the sums of its letters' probabilities, by language."""
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    text, begin = np.frombuffer(b"".join(raw).lower(), np.uint8), np.cumsum(length) - length
    count = -(-length // STRETCH)
    doc = np.repeat(np.arange(len(raw)), count)
    own = STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(length[doc], own + STRETCH)
    low, high = np.maximum(0, own - CONTEXT), np.minimum(length[doc], end + CONTEXT)
    order = np.argsort(low - high, kind="stable")
    out = np.zeros((len(raw), len(net.langs)))
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        x, live = _lanes(text, (begin[doc] + low)[some], (high - low)[some])
        time = np.arange(len(x))[:, None]
        counts = _COUNTED[x] & (time >= (own - low)[some]) & (time < (end - low)[some])
        np.add.at(out, doc[some], np.einsum("ltn,tn->nl", _labels(net, x, live), counts.astype(np.float32)))
    return out


def predict(net: Network, raw: list[bytes]) -> tuple[list[str], list[float]]:
    """The language and score of each text, given as UTF-8."""
    langs, scores = ["und"] * len(raw), [0.0] * len(raw)
    spoken = [i for i, b in enumerate(raw) if b and (_ASCII_LETTER[np.frombuffer(b, np.uint8)].any() or LETTER.search(b.decode()))]
    size = np.cumsum([len(raw[i]) for i in spoken]) // PART_BYTES
    for part in np.split(np.array(spoken, np.int64), np.flatnonzero(np.diff(size)) + 1):
        if not len(part):
            continue
        sums = _sums(net, [raw[i] for i in part])
        best = sums.argmax(axis=1)
        for i, k, s in zip(part.tolist(), best.tolist(), (sums[np.arange(len(part)), best] / sums.sum(axis=1)).tolist(), strict=True):
            langs[i], scores[i] = net.langs[k], min(1.0, round(s, 6))
    return langs, scores


def held_out(column: str = "doc_id"):
    """True where crc32 of doc_id as text leaves no remainder; null ids are held out from training as well."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(True))


def learned(docs: DataFrame) -> Network | None:
    """Trains on a bounded sample of pieces of the rows with text and language that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text", F.ceil(F.length("text") / SEGMENT).alias("pieces")).where("pieces > 0")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("pieces").alias("n")).collect()}
    if not sizes:
        return None
    most = max(1, MOST_SEGMENTS // len(sizes))
    chosen = F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(int(2**30 * min(1.0, most / n)))))) if len(sizes) > 1 else None
    bound = chosen[F.col("lang")] if chosen is not None else F.lit(int(2**30 * min(1.0, most / next(iter(sizes.values())))))
    of_text = F.xxhash64("doc_id", "text")
    drawn = known.withColumn("of_text", of_text).withColumn("bound", bound)
    piece = F.explode(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.pmod(F.xxhash64("of_text", i), F.lit(2**30)) < F.col("bound")))
    drawn = drawn.select("doc_id", "lang", "text", piece.alias("piece"))
    rows = drawn.select("doc_id", "piece", "lang", F.substr("text", (F.col("piece") * SEGMENT + 1).cast("int"), F.lit(SEGMENT)).alias("text")).distinct().limit(2 * MOST_SEGMENTS).collect()
    return train([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"], r["lang"], r["text"]))])


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; trains on docs unless a network is given. No shuffle of texts."""
    net = net or learned(docs)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def make():
        def each(batch: pa.RecordBatch) -> dict[str, object]:
            langs, scores = predict(net, utf8(batch))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores}

        return each

    return map_batches(rows, make, SCHEMA)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, whose language is known (not `und`). Repeated rows stay."""
    net = learned(docs)
    if net is None:
        return docs.limit(0)

    @F.arrow_udf("string")
    def language(column: pa.Array) -> pa.Array:
        hold()
        return pa.array(predict(net, [t or b"" for t in column.cast(pa.binary()).to_pylist()])[0])

    ship(docs.sparkSession)
    return docs.where(language(F.col("text")) != "und")
