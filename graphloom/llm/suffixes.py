"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes when a string of LENGTH bytes that covers it also starts earlier. Not every suffix is sorted. Each string
of LENGTH bytes holds, at a place that its content alone decides, a smallest-hash gram of GRAM bytes: its anchor. Two
equal strings have equal anchors at equal places, so suffixes from anchors suffice; and of those only the ones whose
gram occurs at two anchors can matter (one exchange of hashes finds them). Each task sorts its suffixes, keeps one of
those with equal surroundings (the rest are settled there), front-codes the sorted runs and sends them by range. In a
range a loser tree merges the runs; every entry knows the prefix it shares with the last suffix put out, so no known
prefix is compared again, and the prefixes that the tree puts out delimit the suffixes with a gram in common. Among
those, the earliest start of every string through the anchor stays and the others' bytes go.

Defined results: a null or empty text has 0 bytes and the hash of the empty string; documents are ordered by doc_id
(null first), then by a checksum of the text where a doc_id has several texts; rows equal in both are one document and
get the same answer; an empty table gives an empty result; extra columns are ignored; matches never cross documents; very
long texts are read whole, and a repeat within one counts.
"""

from __future__ import annotations

import copy
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from graphloom.llm.common import blobs_by_part, by_part, gather, mix64, pack, partitions, scatter, slices, text_bytes, tune, worker_state

LENGTH = 100
GRAM = 32
#: Places in a string of LENGTH bytes where its anchor can be.
PLACES = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
SLICE = 1 << 20
#: Bytes of suffixes that a task sorts into one run.
RUN_BYTES = 24 << 20
#: Anchors looked at for each range to choose where it ends: they decide the balance and nothing else.
HEADS_A_RANGE = 64
#: Suffixes of whole groups that are compared at once.
GROUP_BATCH = 16_384
_BASE = 0x9E3779B97F4A7C15
NO_ID = -(1 << 63)
SPAN = (np.int64, np.uint32, np.uint32, np.uint32)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2 ** 64."""
    state = worker_state("suffixes").__dict__
    if len(state.get("powers", ((),))[0]) < n:
        size = max(n, SLICE + LENGTH)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        state["powers"] = tuple(tables)
    return state["powers"]


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of `length` bytes in data."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[length:] - sums[:n]) * down[:n])


def _extreme(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over every `width` neighbours of x."""
    done = 1
    while 2 * done <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(grams: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Places of the smallest gram of each `places` neighbours, all of equal ones."""
    if len(grams) < places:
        return np.empty(0, np.int64)
    low = _extreme(grams, places, np.minimum)
    pad = np.zeros(places - 1, np.uint64)
    return np.flatnonzero(_extreme(np.concatenate((pad, low, pad)), places, np.maximum) == grams)


def find_anchors(docs: DataFrame, n_parts: int) -> DataFrame:
    """Blobs of (gram, doc_id, tag, place, settled), dealt by gram.

    settled: the surroundings (LEFT bytes before, LENGTH from it) occur earlier in the same batch, so they go for certain.
    """

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            data, offsets = text_bytes(batch.column(2))
            held, base = [], []
            for i, j in slices(offsets, SLICE):
                body, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                grams = rolling(body, GRAM)
                wide = rolling(body, LEFT + LENGTH)
                for k in range(j - i):
                    b, e = int(own[k]), int(own[k + 1])
                    if e - b < LENGTH:
                        continue
                    at = anchors(grams[b : e - GRAM + 1])
                    around = np.zeros(len(at), np.uint64)
                    full = (at >= LEFT) & (at + LENGTH <= e - b)
                    around[full] = wide[b + at[full] - LEFT]
                    held.append((grams[b + at], np.full(len(at), ids[i + k]), np.full(len(at), tags[i + k]), at.astype(np.uint32), around))
                    base.append(offsets[i + k] + at)
            if not held:
                continue
            gram, doc, tag, place, around = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, tag, doc, around))
            a = around[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1])))
            # repeated rows are one document: the first of equal rows decides for all
            later = ~fresh & (a != 0)
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
            is_lead = (doc[order] == doc[order][lead]) & (tag[order] == tag[order][lead]) & (place[order] == place[order][lead])
            # equal hashes are a hint: only bytes that are equal settle anything
            found = np.flatnonzero(later & ~is_lead)
            where = np.concatenate(base)[order] - LEFT
            for k in range(0, len(found), 16_384):
                some = found[k : k + 16_384]
                span = np.arange(LEFT + LENGTH)
                same = (data[where[some][:, None] + span] == data[where[lead[some]][:, None] + span]).all(axis=1)
                later[some[~same]] = False
            settled = np.zeros(len(a), np.uint8)
            settled[order] = later & ~is_lead
            part = (gram & np.uint64(0x7FFFFFFF)) % np.uint64(n_parts)
            rows = [(p, squeeze.compress(pack(*x))) for p, x in scatter(part, n_parts, gram, doc, tag, place, settled)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    return docs.select("order_id", "tag", "text").mapInArrow(run, "part int, blob binary")


def repeated_anchors(found: DataFrame, n_parts: int) -> DataFrame:
    """(order_id, tag, places): each document's anchors that can matter; the high bit marks settled ones."""

    def by_gram(batches):
        squeeze, unsqueeze = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for _, blobs in blobs_by_part(batches):
            gram, doc, tag, place, settled = gather([unsqueeze.decompress(b) for b in blobs], np.uint64, np.int64, np.uint32, np.uint32, np.uint8)
            order = np.argsort(gram, kind="stable")
            g = gram[order]
            start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            count = np.diff(np.append(start, len(g)))
            keep = order[np.repeat(count, count) > 1]
            keep = keep[np.lexsort((place[keep], doc[keep]))]
            part = doc[keep].view(np.uint64) % np.uint64(n_parts)
            rows = [(p, squeeze.compress(pack(*x))) for p, x in scatter(part, n_parts, doc[keep], tag[keep], place[keep] | settled[keep].astype(np.uint32) << np.uint32(31))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    def by_doc(batches):
        for _, blobs in blobs_by_part(batches):
            doc, tag, place = gather(expand(pa.array(blobs, pa.binary())), np.int64, np.uint32, np.uint32)
            yield from _per_document(doc, tag, (place,), "places")

    dealt = by_part(found, n_parts).mapInArrow(by_gram, "part int, blob binary")
    return by_part(dealt, n_parts).mapInArrow(by_doc, "order_id long, tag long, places binary")


def _per_document(doc: np.ndarray, tag: np.ndarray, arrays, name: str):
    """One row for each document, with its values packed."""
    if not len(doc):
        return
    order = np.lexsort((*reversed(arrays), tag, doc))
    doc, tag, arrays = doc[order], tag[order], [a[order] for a in arrays]
    start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
    ends = np.append(start[1:], len(doc))
    blobs = [pack(*(a[i:j] for a in arrays)) for i, j in zip(start.tolist(), ends.tolist())]
    for i in range(0, len(blobs), 2000):
        at = start[i : i + 2000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(tag[at].astype(np.int64)), pa.array(blobs[i : i + 2000], pa.binary())], ["order_id", "tag", name]
        )


def choose_ranges(docs: DataFrame, n_parts: int) -> np.ndarray:
    """Sorted heads of GRAM bytes that cut the suffixes of docs(order_id, tag, text) into n_parts ranges of like size.

    They come from anchors of rows all over the table, HEADS_A_RANGE for each range at any size of it. All suffixes with
    one gram are in one range, so a gram is as far as a range can be cut.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = n_parts * HEADS_A_RANGE
    share = min(1.0, wanted * (PLACES + 1) / 2 / max(1, total))  # one anchor in (PLACES + 1) / 2 bytes
    rows = min(1.0, 16 * share)  # of each row some anchors, so that a long text weighs what it holds
    least = min(2**64 - 1, int(share / rows * 2**64))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            heads = []
            for i, j in slices(offsets, SLICE):
                body, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                grams = rolling(body, GRAM)
                for b, e in zip(own[:-1].tolist(), own[1:].tolist()):
                    if e - b >= LENGTH:
                        at = b + anchors(grams[b : e - GRAM + 1])
                        at = at[mix64(grams[at]) <= np.uint64(least)]
                        heads += [body[k : k + GRAM].tobytes() for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary())], ["head"])

    some = docs.where(F.pmod(F.xxhash64("order_id", "tag", F.lit(1)), F.lit(1 << 30)) < int(rows * (1 << 30))).select("text")
    heads = sorted(bytes(r["head"]) for r in some.mapInArrow(run, "head binary").collect())  # about HEADS_A_RANGE * GRAM bytes a range
    if n_parts < 2 or not heads:
        return np.empty(0, f"S{GRAM}")
    return np.unique(np.array([heads[k * len(heads) // n_parts] for k in range(1, n_parts)], f"S{GRAM}"))


class RunWriter:
    """Collects suffixes of a task and turns them into front-coded runs, one for each range."""

    def __init__(self, ranges: np.ndarray):
        self.ranges, self.squeeze = ranges, zstandard.ZstdCompressor(level=6)
        self.clear()

    def clear(self):
        self.size, self.bodies, self.meta = 0, [], []

    def add(self, data: np.ndarray, doc: int, tag: int, place: np.ndarray):
        padded = np.concatenate((np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)))
        self.bodies.append(padded[place[:, None] + np.arange(LEFT + LENGTH)])
        n = len(place)
        left, right = np.minimum(place, LEFT), np.minimum(len(data) - place, LENGTH)
        self.meta.append((np.full(n, doc, np.int64), np.full(n, tag, np.uint32), place.astype(np.uint32), left.astype(np.uint8), right.astype(np.uint8)))
        self.size += n * (LEFT + LENGTH)

    def runs(self):
        """((range, blob) of each run, spans settled here)."""
        if not self.bodies:
            return [], []
        body = np.concatenate(self.bodies)
        doc, tag, place, left, right = (np.concatenate(x) for x in zip(*self.meta))
        self.clear()
        whole = np.ascontiguousarray(np.concatenate((body[:, LEFT:], body[:, :LEFT]), axis=1)).view(f"S{LEFT + LENGTH}").ravel()
        order = np.lexsort((place, tag, doc, right, left, whole))
        body, doc, tag, place, left, right = (x[order] for x in (body, doc, tag, place, left, right))
        same = np.concatenate(([False], (body[1:] == body[:-1]).all(axis=1))) & (left == LEFT) & (right == LENGTH)
        same[1:] &= (left[:-1] == LEFT) & (right[:-1] == LENGTH)
        # of equal surroundings the earliest stands for all; the others go for certain, unless it is the same document
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
        own = (doc == doc[lead]) & (tag == tag[lead]) & (place == place[lead])
        gone = same & ~own
        settled = (doc[gone], tag[gone], place[gone] - LEFT, place[gone] + LENGTH)
        stay = ~same
        body, doc, tag, place, left, right = (x[stay] for x in (body, doc, tag, place, left, right))
        head = np.ascontiguousarray(body[:, LEFT : LEFT + GRAM]).view(f"S{GRAM}").ravel()
        part = np.searchsorted(self.ranges, head, "right")
        differs = body[1:, LEFT:] != body[:-1, LEFT:]
        lcp = np.concatenate(([0], np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH))) if len(body) else np.empty(0, np.int64)
        lcp = np.minimum(lcp, right)
        lcp[1:] = np.minimum(lcp[1:], right[:-1])
        out = []
        edges = np.searchsorted(part, np.arange(len(self.ranges) + 2))
        for p in range(len(self.ranges) + 1):
            i, j = int(edges[p]), int(edges[p + 1])
            if i == j:
                continue
            lcp[i] = 0
            columns = np.arange(LENGTH)
            tails = body[i:j, LEFT:][(columns >= lcp[i:j, None]) & (columns < right[i:j, None])]
            lefts = body[i:j, :LEFT][np.arange(LEFT) >= LEFT - left[i:j, None]]
            blob = np.array([j - i], np.int64).tobytes() + pack(doc[i:j], tag[i:j], place[i:j], left[i:j], right[i:j], lcp[i:j].astype(np.uint8)) + tails.tobytes() + lefts.tobytes()
            out.append((p, self.squeeze.compress(blob)))
        return out, settled


def sort_runs(texts: DataFrame, ranges: np.ndarray, n_parts: int) -> DataFrame:
    """(part, kind, blob): kind 0 is a front-coded run of a range, kind 1 spans that are settled."""

    def run(batches):
        writer, spans = RunWriter(ranges), []

        def flush():
            nonlocal spans
            runs, settled = writer.runs()
            if len(settled):
                spans.append(settled)
            rows = [(p, 0, b) for p, b in runs]
            spans = [x for x in spans if len(x[0])]
            if spans:
                doc, tag, low, high = (np.concatenate(x).astype(t) for x, t in zip(zip(*spans), SPAN))
                # each task deals its own another way, so that no range has the spans of all
                part = mix64(np.array([doc[0], len(doc)], np.int64).view(np.uint64)).sum(dtype=np.uint64) % np.uint64(n_parts)
                order = np.lexsort((low, tag, doc))  # like numbers side by side compress
                rows.append((int(part), 1, writer.squeeze.compress(pack(doc[order], tag[order], low[order], high[order]))))
                spans = []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "blob"]
            )

        for batch in batches:
            data, offsets = text_bytes(pa.array(expand(batch.column(2)), pa.binary()))
            for k, (doc, tag, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                place = np.frombuffer(places, np.uint32)
                done = (place >> np.uint32(31)) == 1
                place = (place & np.uint32(0x7FFFFFFF)).astype(np.int64)
                gone = place[done]
                if len(gone):
                    spans.append((np.full(len(gone), doc, np.int64), np.full(len(gone), tag, np.int64), gone - LEFT, gone + LENGTH))
                for i in range(0, len(place) - len(gone), 50_000):
                    writer.add(data[offsets[k] : offsets[k + 1]], doc, tag, place[~done][i : i + 50_000])
                    if writer.size > RUN_BYTES:
                        yield flush()
        yield flush()

    return texts.mapInArrow(run, "part int, kind int, blob binary")


class Run:
    """A front-coded run, read suffix by suffix."""

    def __init__(self, blob: bytes):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        self.n, at, arrays = n, 8, []
        for kind in (np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8):
            arrays.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.doc, self.tag, self.place, self.left, self.right, lcp = arrays
        self.lcp, self.blob, self.at, self.i, self.key = lcp.tolist(), blob, at, -1, b""
        self.rights = self.right.tolist()
        tail = at + int((self.right.astype(np.int64) - lcp).sum())
        self.left_data = np.frombuffer(blob, np.uint8, offset=tail)

    def advance(self) -> int:
        """The prefix shared with the suffix before; -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            self.key = None
            return -1
        shared = self.lcp[self.i]
        end = self.at + self.rights[self.i] - shared
        self.key = self.key[:shared] + self.blob[self.at : end]
        self.at = end
        return shared


def merge(runs: list[Run]):
    """(prefix shared with the suffix put out before, run) in order, by a loser tree that never compares known prefixes."""
    k = 1
    while k < len(runs):
        k *= 2
    keys = [None] * k  # heads
    known = [-1] * k  # prefix that each head shares with the last suffix put out; -1: the run is at its end
    for s, r in enumerate(runs):
        if r.advance() >= 0:
            known[s] = 0
            keys[s] = r.key

    def loses(s: int, t: int) -> bool:
        """Whether s loses to t, both known to share known[] with the last output; the loser learns what it shares with the winner."""
        a, b = known[s], known[t]
        if a != b:
            return a < b
        if a < 0:
            return False
        x, y = keys[s], keys[t]
        i, n = a, min(len(x), len(y))
        while i + 8 <= n and x[i : i + 8] == y[i : i + 8]:
            i += 8
        while i < n and x[i] == y[i]:
            i += 1
        if i == len(x) or (i < len(y) and x[i] < y[i]):
            known[t] = i
            return False
        known[s] = i
        return True

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        s, t = build(2 * node), build(2 * node + 1)
        if loses(s, t):
            s, t = t, s
        losers[node] = t
        return s

    winner = build(1)
    while known[winner] >= 0:
        run = runs[winner]
        yield known[winner], run
        known[winner] = run.advance()
        keys[winner] = run.key
        s = winner
        node = (s + k) >> 1
        while node:
            t = losers[node]
            if loses(s, t):
                losers[node], s = s, t
            node >>= 1
        winner = s


def repeated_spans(groups: np.ndarray, body: np.ndarray, left: np.ndarray, right: np.ndarray, doc, tag, place):
    """Of suffixes with their surroundings, in groups of one gram: the bytes of strings through the gram that start earlier elsewhere."""
    order = np.lexsort((place, tag, doc, groups))
    first = np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (groups, doc, tag, place)], axis=0)))
    order = order[first]
    body, left, right, doc, tag, place = (x[order] for x in (body, left, right, doc, tag, place))
    up, down = _power_tables(LEFT + LENGTH + 1)
    sums = np.zeros((len(body), LEFT + LENGTH + 1), np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: LEFT + LENGTH], axis=1, out=sums[:, 1:])
    strings = mix64((sums[:, LENGTH:] - sums[:, :PLACES]) * down[:PLACES])
    at = np.arange(PLACES)
    valid = (at >= LEFT - left[:, None].astype(np.int64)) & (at + LENGTH <= LEFT + right[:, None].astype(np.int64))
    again = np.zeros(valid.shape, bool)
    for x in range(PLACES):
        rows = np.flatnonzero(valid[:, x])
        if len(rows) > 1:
            _, lead, back = np.unique(strings[rows, x], return_index=True, return_inverse=True)
            hits = np.flatnonzero(lead[back] != np.arange(len(rows)))
            if not len(hits):
                continue
            # equal hashes are a hint: should the bytes differ, the bytes themselves are compared
            if (body[rows[hits], x : x + LENGTH] != body[rows[lead[back[hits]]], x : x + LENGTH]).any():
                whole = np.ascontiguousarray(body[rows, x : x + LENGTH]).view(f"V{LENGTH}").ravel()
                _, lead, back = np.unique(whole, return_index=True, return_inverse=True)
                hits = np.flatnonzero(lead[back] != np.arange(len(rows)))
            again[rows[hits], x] = True
    hit = again.any(axis=1)
    low = again[hit].argmax(axis=1)
    high = PLACES - 1 - again[hit][:, ::-1].argmax(axis=1)
    base = place[hit].astype(np.int64) - LEFT
    return doc[hit], tag[hit], (base + low).astype(np.uint32), (base + high + LENGTH).astype(np.uint32)


def merge_ranges(runs: DataFrame, n_parts: int) -> DataFrame:
    """Spans (order_id, tag, from, to) that go, dealt by document."""

    def deal(spans):
        doc, tag, low, high = spans
        part = doc.view(np.uint64) % np.uint64(n_parts)
        order = np.lexsort((low, tag, doc))  # like numbers side by side compress
        squeeze = zstandard.ZstdCompressor(level=3)
        rows = [(p, squeeze.compress(pack(*x))) for p, x in scatter(part[order], n_parts, doc[order], tag[order], low[order], high[order])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    def merge_one(blobs):
        own = [Run(b) for b in blobs]
        offsets = [np.cumsum(r.left.astype(np.int64)) - r.left for r in own]
        keys_, run_, index_, groups_ = [], [], [], []

        def flush():
            which, index = np.array(run_), np.array(index_)
            n = len(which)
            left, right, doc, tag, place = (np.empty(n, t) for t in (np.uint8, np.uint8, np.int64, np.uint32, np.uint32))
            body = np.zeros((n, LEFT + LENGTH), np.uint8)
            joined = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in keys_), np.uint8).reshape(n, LENGTH)
            body[:, LEFT:] = joined
            for w in np.unique(which).tolist():
                rows = np.flatnonzero(which == w)
                r, i = own[w], index[rows]
                left[rows], right[rows], doc[rows], tag[rows], place[rows] = r.left[i], r.right[i], r.doc[i], r.tag[i], r.place[i]
                l = r.left[i].astype(np.int64)
                mask = np.arange(LEFT) >= LEFT - l[:, None]
                source = offsets[w][i][:, None] + np.arange(LEFT) - (LEFT - l[:, None])
                block = np.zeros((len(rows), LEFT), np.uint8)
                block[mask] = r.left_data[source[mask]]
                body[rows, :LEFT] = block
            return repeated_spans(np.array(groups_), body, left, right, doc, tag, place)

        number = {id(r): w for w, r in enumerate(own)}
        group, size = 0, 0
        for shared, r in merge(own):
            if shared < GRAM:
                if size == 1:
                    for x in (keys_, run_, index_, groups_):
                        x.pop()
                if len(keys_) >= GROUP_BATCH:
                    yield flush()
                    for x in (keys_, run_, index_, groups_):
                        x.clear()
                group, size = group + 1, 0
            size += 1
            keys_.append(r.key)
            run_.append(number[id(r)])
            index_.append(r.i)
            groups_.append(group)
        if size == 1:
            for x in (keys_, run_, index_, groups_):
                x.pop()
        if keys_:
            yield flush()

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor()
        now, held = None, []
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if held:
                        for spans in merge_one(held):
                            yield deal(spans)
                    now, held = part, []
                blob = unsqueeze.decompress(blob)
                if kind:
                    yield deal(gather([blob], *SPAN))
                else:
                    held.append(blob)
        if held:
            for spans in merge_one(held):
                yield deal(spans)

    return runs.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(run, "part int, blob binary")


def spans_by_document(spans: DataFrame, n_parts: int) -> DataFrame:
    """(order_id, tag, spans): maximal disjoint runs of removed bytes, as packed (from, to)."""

    def run(batches):
        for _, blobs in blobs_by_part(batches):
            doc, tag, low, high = gather(expand(pa.array(blobs, pa.binary())), *SPAN)
            if not len(doc):
                continue
            order = np.lexsort((low, tag, doc))
            doc, tag, low, high = doc[order], tag[order], low[order].astype(np.int64), high[order].astype(np.int64)
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
            # documents one behind another on one line, so that a running maximum serves all
            lift = np.cumsum(new) << 33
            top = np.maximum.accumulate(lift + high)
            start = np.concatenate(([True], (lift + low)[1:] > top[:-1]))
            first = np.flatnonzero(start)
            last = np.append(first[1:], len(doc)) - 1
            yield from _per_document(doc[first], tag[first], (low[first].astype(np.uint32), (top[last] - lift[last]).astype(np.uint32)), "spans")

    return by_part(spans, n_parts).mapInArrow(run, "order_id long, tag long, spans binary")


def squeezed(df: DataFrame) -> DataFrame:
    """df with its text column compressed, for the shuffles that carry texts."""
    schema = copy.deepcopy(df.schema)
    at = schema.names.index("text")
    schema[at].dataType = BinaryType()

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=4)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else squeeze.compress(t) for t in columns[at].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def expand(column: pa.Array) -> list[bytes | None]:
    unsqueeze = zstandard.ZstdDecompressor()
    return [None if t is None else unsqueeze.decompress(t) for t in column.to_pylist()]


def removed_spans(docs: DataFrame) -> DataFrame:
    """docs with text compressed, and order_id, tag and spans (packed, null if nothing goes)."""
    spark = docs.sparkSession
    tune(spark)
    n_parts = partitions(spark)
    keyed = docs.withColumn("order_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("tag", F.crc32(F.coalesce("text", F.lit(""))).cast("long"))
    slim = keyed.filter(F.octet_length("text") >= LENGTH).select("order_id", "tag", "text")
    ranges = choose_ranges(slim, n_parts)
    places = repeated_anchors(find_anchors(slim, n_parts), n_parts)
    texts = squeezed(slim).join(places, ["order_id", "tag"]).select("order_id", "tag", "text", "places")
    spans = spans_by_document(merge_ranges(sort_runs(texts, ranges, n_parts), n_parts), n_parts)
    return squeezed(keyed).join(spans, ["order_id", "tag"], "left")


def _bounds(blob: bytes | None) -> list[tuple[int, int]]:
    if not blob:
        return []
    n = len(blob) // 8
    return list(zip(np.frombuffer(blob, np.uint32, n).tolist(), np.frombuffer(blob, np.uint32, n, 4 * n).tolist()))


def _kept(text: bytes, bounds: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for low, high in bounds:
        out.append(text[at:low])
        at = high
    out.append(text[at:])
    return b"".join(out)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text)."""
    marked = removed_spans(docs.select("doc_id", "text")).select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            rows = []
            for text, blob in zip(expand(batch.column(1)), batch.column(2).to_pylist()):
                text, bounds = text or b"", _bounds(blob)
                rows.append((len(text), sum(e - b for b, e in bounds), len(bounds), hashlib.sha256(_kept(text, bounds)).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs, columns as they are, with repeated bytes taken out of text; a character cut in part goes whole."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # other columns travel in one struct, so that no name of theirs can clash
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("others"))
    marked = removed_spans(packed).select("doc_id", "text", "others", "spans")

    def run(batches):
        for batch in batches:
            new = [None if t is None else _kept(t, _bounds(b)).decode(errors="ignore") for t, b in zip(expand(batch.column(1)), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), batch.column(2)], ["doc_id", "text", "others"])

    rows = marked.mapInArrow(run, packed.schema)
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
