"""Quality rules by line sequence labelling: a linear-chain conditional random field marks each line as content or
boilerplate (Viterbi decoding), and the share of characters in content lines decides whether a document is kept.

The field is trained here, by gradient ascent on the conditional log-likelihood, on lines of a bounded sample of
labelled documents: at most `MOST_LABELLED` rows of labels by the hash of their id, with texts of `MOST_LABELLED_BYTES`
bytes at most, whose lines take the document's quality as their label. Without labels of both kinds (an empty table) the
lines of `examples` are used instead; without any of these the training fails.

Base rules: n_words < 50, or 100 * n_repeat_words > 50 * n_words, fail a document whatever the field says.

Edge cases: a null or empty text has no words and fails; a text is read whole, whatever its length; repeated rows each
get the same result; null ids are kept; an empty table gives an empty result; other columns are ignored by `score` and
pass through `keep` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.kernels import Words, chunks, grams, mix, row_sums, tidy

MOST_LABELLED = 2000
MOST_LABELLED_BYTES = 1 << 16
Examples = tuple[tuple[str, bool], ...]
SEGMENT = 24
LEAST_SHARE = 0.5
_WHITE = " \t\n\v\f\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAVY = _SYMBOL.copy()
_HEAVY[list(b"!^~=+_{}[]\\@")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

#: Examples for when no labels are at hand; True marks content.
EXAMPLES = (
    ("The committee met in the morning to go through the plans for the new bridge, and agreed on most of them.", True),
    ("After the rain had stopped, people came back into the street and opened their shops again.", True),
    ("He had written the letter twice before he was content with it.", True),
    ("Short lines are part of a text as well.", True),
    ("HOME!! LOGIN!! CLICK HERE!! BUY NOW!! LAST CHANCE!!", False),
    ("Home | About | Contact | Terms | Privacy | Sitemap", False),
    ("### *** $$$ now&&& best%%% offer### ever*** $$$", False),
    ("<< prev || next >> ## top ## ||", False),
)


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word in it, the row it is from, and its length in bytes."""
    w = Words(column)
    n = len(w.data)
    stop = w.data == 10
    tails = w.offsets[1:]
    edge = np.unique(np.concatenate([np.flatnonzero(stop) + 1, tails, [0]]))
    begin, end = edge[:-1], edge[1:]
    words = np.searchsorted(w.begin, edge)
    count = np.diff(words)
    has = count > 0

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[begin]) / np.maximum(of, 1)

    chars = np.zeros(n + 1, np.int64)
    np.cumsum(w.is_word, out=chars[1:])
    letters = chars[end] - chars[begin]
    upper, heavy, symbol, digit = (share(m[w.data], letters) for m in (_UPPER, _HEAVY, _SYMBOL, _DIGIT))
    pipe = share(w.data == 124, count)
    bang = share(w.data == 33, count)
    some = count >= 4  # capitals say little of a line of a few words
    cols = [np.ones(len(begin)), some & (upper > 0.3), some & (upper > 0.6), heavy > 0.04, heavy > 0.12, symbol > 0.08, pipe > 0.2, bang > 0.3, digit > 0.3, count > 12, letters / np.maximum(count, 1) > 12]
    return np.stack([np.asarray(c, float) for c in cols], 1)[has], np.searchsorted(w.offsets, begin[has], "right") - 1, (end - begin)[has]


def _forward_backward(scores: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of states and of transitions (summed) for padded sequences, in log space."""
    b, t, _ = scores.shape
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for i in range(1, t):
        ways = alpha[:, i - 1, :, None] + trans
        alpha[:, i] = np.logaddexp(ways[:, 0], ways[:, 1]) + scores[:, i]
    for i in range(t - 2, -1, -1):
        ways = trans + (scores[:, i + 1] + beta[:, i + 1])[:, None, :]
        step = np.logaddexp(ways[..., 0], ways[..., 1])
        beta[:, i] = np.where((i + 1 < size)[:, None], step, 0)
    logz = np.logaddexp(*alpha[np.arange(b), size - 1].T)
    inside = np.arange(t)[None] < size[:, None]
    unary = np.exp(alpha + beta - logz[:, None, None]) * inside[..., None]
    pair = alpha[:, :-1, :, None] + trans + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None]
    return unary, (np.exp(np.minimum(pair, 0)) * inside[:, 1:, None, None]).sum((0, 1))


def train(texts: list[str], labels: list[int], rounds: int = 50, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2 states) and transitions (2 x 2) of the field; state 1 is content."""
    x, row, _ = line_features(pa.array(texts, pa.string()))
    y = np.asarray(labels)[row]
    new = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    seq = np.unique(row * (1 << 20) + place // SEGMENT, return_inverse=True)[1]
    size = np.bincount(seq)
    slot = place % SEGMENT
    feats = np.zeros((len(size), int(size.max()), x.shape[1]))
    feats[seq, slot] = x
    gold = np.zeros((*feats.shape[:2], 2))
    gold[seq, slot, y] = 1
    gold_pairs = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    steps = [np.zeros_like(w), np.zeros_like(trans)]
    for _ in range(rounds):
        unary, pairs = _forward_backward(feats @ w, size, trans)
        for k, (p, g) in enumerate(((w, np.einsum("btf,bts->fs", feats, gold - unary) / len(x) - decay * w), (trans, (gold_pairs - pairs) / len(x) - decay * trans))):
            steps[k] = 0.9 * steps[k] + g
            p += 0.5 * steps[k]
    return w, trans


def viterbi(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best states of ragged sequences scores[first[i]:first[i + 1]], all sequences a step at a time, longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, head = size[order], first[:-1][order]
    state = np.zeros(len(scores), np.int8)
    if not len(scores):
        return state
    best, back = np.zeros((len(size), 2)), np.zeros((len(scores), 2), np.int8)
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # sequences longer than each step
    for t in range(int(size[0])):
        k = int(active[t])
        at = head[:k] + t
        if t == 0:
            best[:k] = scores[at]
            continue
        ways = best[:k, :, None] + trans
        back[at] = ways.argmax(1)
        best[:k] = ways.max(1) + scores[at]
    some = size > 0
    last = best.argmax(1).astype(np.int8)
    state[(head + size - 1)[some]] = last[some]
    for t in range(int(size[0]) - 1, 0, -1):
        k = int(active[t])
        at = head[:k] + t
        state[at - 1] = back[at, state[at]]
    return state


def labelled_model(docs: DataFrame, labels: DataFrame | None, examples: Examples) -> tuple[np.ndarray, np.ndarray]:
    """The field trained on the bounded labelled sample, or on the examples if that lacks one of the two labels; an error
    if there are no examples either."""
    texts, marks = [], []
    if labels is not None:
        known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        # both kinds are taken up to half the bound, in the order of a hash of the id
        parts = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED // 2) for q in (0, 1)]
        sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most MOST_LABELLED rows
        rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= MOST_LABELLED_BYTES).join(sample, "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "text", "quality").groupBy("doc_id").agg(F.min(F.struct("h", "text", "quality")).alias("r")).select("doc_id", "r.text", "r.quality").collect()
        rows.sort(key=lambda r: r["doc_id"])
        texts, marks = [r["text"] for r in rows], [int(r["quality"]) for r in rows]
    usable = {m for t, m in zip(texts, marks, strict=True) if t.strip(_WHITE)}
    if usable != {0, 1}:
        if {m for _, m in examples} != {True, False}:
            raise ValueError("no labelled documents of both kinds, and no examples of both")
        texts, marks = [t for t, _ in examples], [int(m) for _, m in examples]
    return train(texts, marks)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def measure(column: pa.Array, w: np.ndarray, trans: np.ndarray, least_share: float) -> dict[str, np.ndarray]:
    """All measures and the verdict for each text of a piece."""
    words = Words(column)
    n = len(words.count)
    starts = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(words.is_word & ((words.data & 0xC0) != 0x80), out=starts[1:])
    chars = starts[words.offsets[1:]] - starts[words.offsets[:-1]]
    symbols = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SYMBOL[words.data], out=symbols[1:])
    symbols = symbols[words.offsets[1:]] - symbols[words.offsets[:-1]]
    h = words.hashes()
    repeat = np.zeros(n, np.int64)
    g = grams(h, 3)
    if len(g):
        inside = np.flatnonzero(words.row[:-2] == words.row[2:])
        key = mix(g[inside] + words.row[inside].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[inside[twice] + k] = True
        repeat = row_sums(covered, words.first)
    dup = np.zeros(n, np.int64)
    for i, text in enumerate(column.to_pylist()):
        lines = [x for x in (text or "").split("\n") if x.strip(_WHITE)]
        dup[i] = len(lines) - len(set(lines))
    x, row, length = line_features(column)
    first = np.searchsorted(row, np.arange(n + 1))
    content = viterbi(x @ w, first, trans) == 1
    share = row_sums(np.where(content, length, 0), first) / np.maximum(row_sums(length, first), 1)
    failed = (words.count < 50) | (100 * repeat > 50 * words.count)
    return {"n_words": words.count.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "content_share": share, "kept": ~failed & (share >= least_share)}


def score(docs: DataFrame, labels: DataFrame | None = None, least_share: float = LEAST_SHARE, examples: Examples = EXAMPLES) -> DataFrame:
    """A row of measures and verdicts for each document."""
    w, trans = labelled_model(docs, labels, examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out = measure(batch.column(1), w, trans, least_share)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], ["doc_id", *out])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame | None = None, least_share: float = LEAST_SHARE, examples: Examples = EXAMPLES) -> DataFrame:
    """The documents that pass, with all their columns."""
    w, trans = labelled_model(docs, labels, examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            kept = measure(batch.column(batch.schema.get_field_index("text")), w, trans, least_share)["kept"]
            yield batch.filter(pa.array(kept))
        tidy()

    return docs.mapInArrow(run, docs.schema)
