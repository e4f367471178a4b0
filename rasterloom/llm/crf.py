"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The field has two states a token. Its features are a token's word, word beginning and end and shape, the words
before and after it, and the move from the state before. Documents carry labels, tokens don't, so tokens' labels
are expected: a document is toxic if any of its tokens is. The likelihood of that has the gradient
c (E[features] - features of the path without a toxic token), c being -1 for a clean document and P0 / (1 - P0)
for a toxic one, P0 the probability of that path; E comes from forward-backward messages. Messages are kept as
ratios, which a token maps by a Moebius transform, so whole batches are scanned at once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

WORD = re.compile(r"[^\W_]+")
#: Labelled documents of each class that are trained on, about, drawn by a hash of the id among those of up to
#: SAMPLE_BYTES; the product bounds what reaches the driver.
SAMPLE, SAMPLE_BYTES = 1500, 16 << 10
#: Characters of word beginnings and ends that are features beside the whole word.
STEMS, ENDS = (3, 4, 5, 6), (3, 4)
#: Training documents that must hold a feature.
SUPPORT = 5
ROUNDS = 90
#: Weight of the penalty on squared weights, in documents.
DECAY = 1.0
#: Tokens of a block of training documents.
BLOCK = 1 << 16
#: Words that a worker remembers.
CACHE = 400_000


def word_features(word: str) -> list[str]:
    """What a token's own word says: itself, beginnings, ends and shape."""
    shape = f"#{min(len(word), 12)}{'d' if any(c.isdigit() for c in word) else ''}{'' if word.isascii() else 'u'}"
    return [f"={word}", shape, *(word[:n] + "-" for n in STEMS if len(word) > n), *("-" + word[-n:] for n in ENDS if len(word) > n)]


def moebius_scan(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """x[t] = (p[t] x[t-1] + q[t]) / (r[t] x[t-1] + s[t]) with x[-1] = 1, all steps of columns at once.

    The sequence is folded into about sqrt(n) columns: their maps are composed row by row, the columns'
    first values follow from those one after another, and a second pass fills in the rest.
    """
    n = len(p)
    rows = max(1, int(np.sqrt(n)))
    cols = -(-n // rows)
    fold = lambda a, fill: np.concatenate([a, np.full(rows * cols - n, fill)]).reshape(cols, rows).T.copy()
    p, q, r, s = fold(p, 1.0), fold(q, 0.0), fold(r, 0.0), fold(s, 1.0)
    a, b, c, d = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for t in range(rows):
        a, b, c, d = p[t] * a + q[t] * c, p[t] * b + q[t] * d, r[t] * a + s[t] * c, r[t] * b + s[t] * d
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    x, first = 1.0, np.empty(cols)
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        first[k] = x
        x = (ka * x + kb) / (kc * x + kd)
    out, x = np.empty((rows, cols)), first
    for t in range(rows):
        x = (p[t] * x + q[t]) / (r[t] * x + s[t])
        out[t] = x
    return out.T.ravel()[:n]


class Messages:
    """Forward and backward messages of chains laid end to end, as ratios of state 1 to state 0.

    emission: log weight of state 1 over 0 of each token; begin: whether a chain begins there; moves: 2 x 2 log
    weights from state to state.
    """

    def __init__(self, emission: np.ndarray, begin: np.ndarray, moves: np.ndarray):
        self.begin, self.m = begin, np.exp(moves)
        self.weight = np.exp(np.clip(emission, -40, 40))
        e, m, end = self.weight, self.m, np.append(begin[1:], True)
        self.ahead = moebius_scan(np.where(begin, 0, e * m[1, 1]), np.where(begin, e, e * m[0, 1]), np.where(begin, 0, m[1, 0]), np.where(begin, 1, m[0, 0]))
        w = np.append(e[1:], 1.0)
        flip = lambda a: a[::-1]
        self.back = moebius_scan(flip(np.where(end, 0, m[1, 1] * w)), flip(np.where(end, 1, m[1, 0])), flip(np.where(end, 0, m[0, 1] * w)), flip(np.where(end, 1, m[0, 0])))[::-1]

    def marginals(self) -> np.ndarray:
        """P(state 1) of each token."""
        odds = self.ahead * self.back
        return odds / (1 + odds)

    def clean(self) -> np.ndarray:
        """log P(state 0 | state 0 before) of each token; a chain's sum is the log probability that it has no token in state 1."""
        return -np.log1p(np.where(self.begin, 1.0, self.m[0, 1] / self.m[0, 0]) * self.weight * self.back)

    def moves(self) -> np.ndarray:
        """P(state i, then state j) of each token and its predecessor, tokens x 4; 0 where a chain begins."""
        before, here = np.append(1.0, self.ahead[:-1]), self.weight * self.back
        joint = np.stack([np.full(len(here), self.m[0, 0]), self.m[0, 1] * here, self.m[1, 0] * before, self.m[1, 1] * before * here], 1)
        return np.where(self.begin[:, None], 0.0, joint / joint.sum(1, keepdims=True))


def begins(starts: np.ndarray) -> np.ndarray:
    """Marks of the first tokens of texts with those starts and end; texts without tokens have none."""
    out = np.zeros(starts[-1], bool)
    out[starts[:-1][np.diff(starts) > 0]] = True
    return out


class Vocabulary:
    """Numbers words and remembers each one's features."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def __call__(self, text: str) -> list[int]:
        number = self.number
        return [number.setdefault(w.lower(), len(number)) for w in WORD.findall(text)]


def _blocks(ids: list[np.ndarray], label: np.ndarray, role: np.ndarray, none: int) -> Iterator[tuple]:
    """Training documents by about BLOCK tokens: words, chain begins, neighbours before and after (`none`: there is none), document, labels."""
    held, n = [], 0
    for k, own in enumerate(ids):
        held.append(k)
        n += len(own)
        if n >= BLOCK or k == len(ids) - 1:
            starts = np.cumsum([0, *(len(ids[j]) for j in held)])
            if n:
                flat, begin = np.concatenate([ids[j] for j in held]), begins(starts)
                before, after = np.append(none, role[flat[:-1]]), np.append(role[flat[1:]], none)
                before[begin] = after[np.append(begin[1:], True)] = none
                yield flat, begin, before.astype(np.int32), after.astype(np.int32), np.repeat(np.arange(len(held)), np.diff(starts)), label[held]
            held, n = [], 0


class ToxicField:
    """The trained field: weights by feature, of words as neighbours, bias, moves, and the curve for documents."""

    def __init__(self, docs: list[tuple[str, int]], support: int = SUPPORT, rounds: int = ROUNDS):
        number, ids = Vocabulary(), []
        for text, _ in docs:
            ids.append(np.array(number(text), np.int32))
        label, words = np.array([y for _, y in docs], float), list(number.number)
        held = np.zeros(len(words), np.int64)
        for own in ids:
            held[np.unique(own)] += 1
        names: dict[str, int] = {}
        at, of = array("i"), array("i")
        for k, w in enumerate(words):
            own = [names.setdefault(f, len(names)) for f in word_features(w)]
            at.extend(own)
            of.extend([k] * len(own))
        at, of = np.array(at, np.int64), np.array(of, np.int64)
        often = np.bincount(at, held[of], len(names)) >= support
        place = np.cumsum(often) - 1
        self.names = {f: int(place[i]) for f, i in names.items() if often[i]}
        at, of = place[at[often[at]]], of[often[at]]
        near = np.flatnonzero(held >= support)
        self.near = {words[k]: i for i, k in enumerate(near)}
        role = np.full(len(words), len(near), np.int32)
        role[near] = np.arange(len(near))
        del names, number
        self._forget()
        self._train(list(_blocks(ids, label, role, len(near))), label, (at, of, len(words)), len(near), rounds)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 3))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _train(self, blocks: list[tuple], label: np.ndarray, features: tuple, kinds: int, rounds: int) -> None:
        """Gradient ascent on the documents' likelihood; every step moves feature weights, bias and moves."""
        at, of, words = features
        size = [len(self.names), kinds + 1, kinds + 1, 1, 4]
        cut = np.cumsum(size)[:-1]
        theta, total = np.zeros(sum(size)), np.zeros(sum(size))
        theta[cut[2]] = -6.0
        decay = np.concatenate([np.full(cut[2], DECAY), np.zeros(1), np.full(4, DECAY)])
        for _ in range(rounds if blocks and 0 < label.mean() < 1 else 0):
            own, b, a, bias, moves = np.split(theta, cut)
            word = np.bincount(of, own[at], words) + bias
            pulled, g = np.zeros(words), [np.zeros(n) for n in size[1:]]
            for flat, begin, before, after, doc, y in blocks:
                chain = Messages(word[flat] + b[before] + a[after], begin, moves.reshape(2, 2))
                p, pairs = chain.marginals(), chain.moves()
                clean = np.bincount(doc, chain.clean(), len(y))
                c = np.where(y > 0, np.minimum(1 / np.maximum(np.expm1(-clean), 1e-6), 50.0), -1.0)[doc]
                pull = c * p
                pairs[:, 0] -= ~begin
                pulled += np.bincount(flat, pull, words)
                for k, part in enumerate((np.bincount(before, pull, kinds + 1), np.bincount(after, pull, kinds + 1), pull.sum(), c @ pairs)):
                    g[k] += part
            g[0][kinds] = g[1][kinds] = 0  # no neighbour is no evidence
            step = np.concatenate([np.bincount(at, pulled[of], size[0]), *g]) - decay * theta
            total += step * step
            theta += 0.4 * step / np.sqrt(total + 1e-8)
        own, self.before, self.after, bias, moves = np.split(theta, cut)
        self.weight, self.bias, self.moves = own, float(bias[0]), moves.reshape(2, 2)
        word = np.bincount(of, own[at], words) + bias
        clean = [np.bincount(doc, Messages(word[flat] + self.before[before] + self.after[after], begin, self.moves).clean(), len(y)) for flat, begin, before, after, doc, y in blocks]
        self.curve = self._calibrate(np.concatenate(clean) if clean else np.zeros(0), np.concatenate([k[-1] for k in blocks]) if blocks else label)

    def _number(self, word: str) -> int:
        """Numbers a word of a text and works out what it weighs as itself, before and after a token."""
        w, n = word.lower(), len(self.known)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        k = self.near.get(w, -1)
        self.table[n] = sum(self.weight[i] for f in word_features(w) if (i := self.names.get(f)) is not None), self.before[k], self.after[k]
        self.known[word] = n
        return n

    def tag(self, batch: list[str]) -> tuple[Messages, np.ndarray]:
        """(messages of all tokens, the first token of each text and the end)."""
        if len(self.known) > CACHE:
            self._forget()
        known, number, flat, starts = self.known, self._number, [], [0]
        for text in batch:
            flat += [k if (k := known.get(w)) is not None else number(w) for w in WORD.findall(text)]
            starts.append(len(flat))
        flat, starts = np.array(flat, np.int64), np.array(starts)
        begin, (score, before, after) = begins(starts), self.table[flat].T
        score = score + self.bias
        score[1:] += np.where(begin[1:], 0.0, before[:-1])
        score[:-1] += np.where(begin[1:], 0.0, after[1:])
        return Messages(score, begin, self.moves) if len(flat) else None, starts

    @staticmethod
    def _summary(clean: np.ndarray) -> np.ndarray:
        """A row a text: 1, log odds that any token is toxic."""
        return np.stack([np.ones(len(clean)), np.clip(np.log(np.maximum(-np.expm1(clean), 1e-9)) - np.maximum(clean, -30), -20, 30)], 1)

    def _calibrate(self, clean: np.ndarray, label: np.ndarray, rounds: int = 25) -> np.ndarray:
        """Newton's method for a logistic curve over the log odds, held back by a small penalty."""
        x, share = self._summary(clean), label.mean() if len(label) else 0.0
        curve = np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0])
        for _ in range(rounds if len(label) else 0):
            y = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            hessian = (x * (y * (1 - y))[:, None]).T @ x + 0.05 * len(label) / 1000 * np.eye(2) + 1e-6 * np.eye(2)
            curve = curve + np.linalg.solve(hessian, x.T @ (label - y) - 0.05 * len(label) / 1000 * curve)
        return curve

    def scores(self, chain: Messages | None, starts: np.ndarray) -> np.ndarray:
        """The score of each text, from the probability that none of its tokens is toxic."""
        clean = np.diff(np.concatenate([[0.0], np.cumsum(chain.clean())])[starts]) if chain else np.zeros(len(starts) - 1)
        return 1 / (1 + np.exp(-np.clip(self._summary(np.minimum(clean, 0.0)) @ self.curve, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> ToxicField:
    """A field from about `sample` labelled documents of each class of up to `most` bytes, drawn by a hash of the id.

    labels: doc_id, toxic; the greatest label of a repeated id counts, null ids and labels don't. The
    sampled ids are bounded by `sample`, so their join with docs sends them to all tasks. Without labels of
    both classes the field has no weights, and every text scores the share of toxic documents.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    draw, share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.lit(False)
    for y, n in sizes.items():
        share = share | ((F.col("toxic") == y) & (draw < min(1 << 20, -(-(sample << 20) // n))))
    drawn = labels.where(share)
    rows = docs.select(F.col("doc_id"), "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= most).join(F.broadcast(drawn), "doc_id").select("text", "toxic").collect()
    return ToxicField(sorted((r.text or "", r.toxic) for r in rows))


def score(docs: DataFrame, field: ToxicField, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns in keep, score (0 to 1), predicted (1 from the threshold on) and spans of each row.

    spans lists (start, end) character offsets of maximal runs of tokens with a marginal above a half. A
    null or empty text has no tokens and gets the curve's score for that. Equal texts have equal scores up to
    rounding; repeated rows repeat; an empty table gives none. Whole texts are tagged; a narrow map over the scan.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = texts(batch)
            chain, starts = held.value.tag(own)
            found, p = held.value.scores(chain, starts), chain.marginals() if chain else np.zeros(0)
            spans = []
            over = np.concatenate([[0], np.cumsum(p > 0.5)])
            for i, text in enumerate(own):
                runs = []
                if over[starts[i + 1]] > over[starts[i]]:
                    last = -2
                    for k, m in enumerate(WORD.finditer(text)):
                        if p[starts[i] + k] > 0.5:
                            if last == k - 1:
                                runs[-1]["end"] = m.end()
                            else:
                                runs.append({"start": m.start(), "end": m.end()})
                            last = k
                spans.append(runs)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array((found >= threshold).astype(np.int32)), pa.array(spans, kind)], [*keep, "score", "predicted", "spans"])

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "score double, predicted int, spans array<struct<start:int,end:int>>"
    return docs.select(*keep, *["text"] * ("text" not in keep)).mapInArrow(run, schema)
