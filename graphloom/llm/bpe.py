"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words of all documents are counted (maximal runs without ASCII white space, which no token crosses). The
LEXICON_WORDS most frequent are compiled into a minimal acyclic automaton: equal suffix subtrees are one state, and
every edge carries the number of words that it skips, so the sum along a path is the word's number, which points to
its ids. The file is memory-mapped by every worker. Words outside it are merged by the tokenizers library itself, so
results equal its own on whole texts.

Defined results: a null or empty text has no tokens, and its hashes are those of the empty string; rows are judged
one by one, so repeated rows and null doc_ids do no harm; an empty table gives an empty result; extra columns are
ignored; special-token strings in a text become special tokens, as in the library.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, share_bytes, tune, worker_state
from graphloom.llm.merging import LONGEST, PLAIN, Merger, lower

#: Most frequent words that the lexicon holds: a bound on its size, not on the result.
LEXICON_WORDS = 65_536
#: Longer words are left to the library.
LONGEST_WORD = 48
#: Words that a worker remembers before it starts afresh.
MEMO_WORDS = 600_000
#: Bytes of text handled at a time.
SLICE = 2 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def open_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def merge_words(tokenizer, words: list[bytes]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]


class WordMerger:
    """Ids, as little-endian 32-bit numbers, of words that have no white space."""

    def __init__(self, tokenizer):
        self.tokenizer, self.ends = tokenizer, {b"": b""}
        self.merger = Merger(tokenizer.to_str())

    def _library(self, words: list[bytes]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in merge_words(self.tokenizer, words)]

    def __call__(self, words: list[bytes]) -> list[bytes]:
        out: list = [None] * len(words)
        plain, stems, marks, others = [], [], [], []
        for i, w in enumerate(words):
            if len(w) <= LONGEST and w.isalpha():  # the usual cases, without the pattern
                stem, mark = w.lower(), b""
            elif len(w) <= LONGEST and w[-1:] in b".," and w[:-1].isalpha():
                stem, mark = w[:-1].lower(), w[-1:]
            elif (m := PLAIN.fullmatch(w)) and m.end(1) <= LONGEST:
                stem, mark = lower(m[1]), m[2]
            else:
                others.append(i)
                continue
            plain.append(i)
            stems.append(stem)
            marks.append(mark)
        new = [x for x in set(marks) if x not in self.ends]
        self.ends.update(zip(new, self._library(new)))
        for i, ids, mark in zip(plain, self.merger.merge(stems), marks):
            out[i] = ids + self.ends[mark]
        for i, ids in zip(others, self._library([words[i] for i in others])):
            out[i] = ids
        return out


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words and their ids, as one file."""
    words = sorted(w for w in entries if 0 < len(w) <= LONGEST_WORD)
    register: dict[tuple, int] = {}
    count: list[int] = []

    def state(lo: int, hi: int, depth: int) -> int:
        final = lo < hi and len(words[lo]) == depth
        i, edges = lo + final, []
        while i < hi:
            byte, j = words[i][depth], i + 1
            while j < hi and words[j][depth] == byte:
                j += 1
            edges.append((byte, state(i, j, depth + 1)))
            i = j
        key = (final, *edges)
        if key not in register:
            register[key] = len(count)
            count.append(final + sum(count[child] for _, child in edges))
        return register[key]

    root = state(0, len(words), 0)
    keys, targets, skips, finals = [], [], [], bytearray(len(count))
    for (final, *edges), number in register.items():
        finals[number] = final
        skipped = int(final)
        for byte, child in edges:
            keys.append(number << 8 | byte)
            targets.append(child)
            skips.append(skipped)
            skipped += count[child]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [entries[w] for w in words]
    ends = np.cumsum([0, *map(len, ids)])
    arrays = [
        np.array(keys, np.int64)[order],
        np.array(targets, np.int64)[order],
        np.array(skips, np.int64)[order],
        np.frombuffer(bytes(finals), np.uint8).astype(np.int64),
        ends.astype(np.int64),
        np.array([x for w in ids for x in w], np.int64),
    ]
    return struct.pack("<8q", root, len(words), *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        head = struct.unpack("<8q", open(path, "rb").read(64))
        self.root, self.size = head[:2]
        at, arrays = 64, []
        for n in head[2:]:
            arrays.append(np.memmap(path, np.int64, "r", at, (n,)) if n else np.empty(0, np.int64))
            at += 8 * n
        self.keys, self.targets, self.skips, self.finals, self.ends, self.ids = arrays

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words that the lexicon lacks."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        states, numbers = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero((lengths <= LONGEST_WORD) & (lengths > 0))
        found = np.full(len(words), -1, np.int64)
        depth = 0
        while len(alive) and len(self.keys):
            done = lengths[alive] == depth
            if done.any():
                ended = alive[done]
                ended = ended[self.finals[states[ended]] == 1]
                found[ended] = numbers[ended]
                alive = alive[~done]
            want = states[alive] << 8 | data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            alive, at = alive[hit], at[hit]
            numbers[alive] += self.skips[at]
            states[alive] = self.targets[at]
            depth += 1
        return found

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.ends[number] : self.ends[number + 1]].astype("<u4").tobytes()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task counts its own rows first."""

    def count(batches):
        from collections import Counter

        def rows(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update((text or b"").split())
            if len(counts) > 500_000:  # partial counts add up after the shuffle
                yield rows(counts)
                counts.clear()
        yield rows(counts)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, n_words: int) -> list[bytes]:
    """Words counted so often that no more than n_words are counted as often: at most n_words rows reach the driver.

    Counts up to 4096 stand for themselves and higher ones for a 64th of an octave, so there are few different ones.
    """
    level = F.when(F.col("n") <= 4096, F.col("n")).otherwise(4096 + F.floor(64 * F.log2(F.col("n") / 4096)) + 1).cast("long")
    levels = counts.select(level.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in levels:
        total += row["words"]
        if total > n_words:
            break
        least = row["level"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in counts.where(level >= least).select("word").collect())


def train_lexicon(docs: DataFrame, tokenizer_path: str, n_words: int = LEXICON_WORDS) -> bytes:
    counts = cut(count_words(docs).filter(F.octet_length("word").between(1, LONGEST_WORD)), "words")
    words = frequent_words(counts, n_words)
    return compile_lexicon(dict(zip(words, merge_words(open_tokenizer(tokenizer_path), words))))


class Encoder:
    """Word by word encoding in a worker: memo, then lexicon, then merging. form turns ids (bytes) into what is kept."""

    def __init__(self, tokenizer_path: str, lexicon_path: str | None, form):
        self.tokenizer = open_tokenizer(tokenizer_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.form, self.memo = form, {}
        self.merge = WordMerger(self.tokenizer)

    def learn(self, texts: list[list[bytes]]) -> dict:
        """A mapping that has form(ids) for each word of the texts."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = list(set(itertools.filterfalse(self.memo.__contains__, itertools.chain.from_iterable(texts))))
        if new and self.lexicon:
            numbers = self.lexicon.numbers(new)
            for i in np.flatnonzero(numbers >= 0).tolist():
                ids = self.lexicon.ids_of(int(numbers[i]))
                self.memo[new[i]] = self.form(ids) if self.form else ids
            new = [new[i] for i in np.flatnonzero(numbers < 0).tolist()]
        if new:
            if self.form is None:
                self.memo.update(zip(new, self.merge(new)))
            else:
                self.memo.update(zip(new, map(self.form, self.merge(new))))
        return self.memo


def encoder(kind: str, tokenizer_path: str, lexicon_path: str | None, make_form) -> Encoder:
    """The worker's encoder of that kind, made once."""
    state = worker_state("bpe").__dict__
    key = (kind, tokenizer_path, lexicon_path)
    if key not in state:
        for old in [k for k in state if isinstance(k, tuple) and k[0] == kind]:
            del state[old]
        made = Encoder(tokenizer_path, lexicon_path, None)
        made.form = make_form(made)
        state[key] = made
    return state[key]


def text_slices(column: pa.Array):
    """Lists of texts of a column, as bytes, of about SLICE bytes each."""
    held, size = [], 0
    for text in column.cast(pa.binary()).to_pylist():
        held.append(text or b"")
        size += len(held[-1])
        if size > SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, tokenizer_path: str, n_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded text of each row of docs(doc_id, text)."""
    return _run(docs, tokenizer_path, n_words, digests=False)


def encode_digests(docs: DataFrame, tokenizer_path: str, n_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the ids and texts themselves never leave the workers."""
    return _run(docs, tokenizer_path, n_words, digests=True)


def _run(docs: DataFrame, tokenizer_path: str, n_words: int, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    lexicon = share_bytes(spark, train_lexicon(docs, tokenizer_path, n_words), "lexicon")
    spark.sparkContext.addFile(tokenizer_path)
    tokenizer = os.path.basename(tokenizer_path)

    def form_for(enc: Encoder):
        names = {}

        def form(ids: bytes) -> tuple[bytes, bytes]:
            numbers = struct.unpack(f"<{len(ids) // 4}I", ids)
            for i in numbers:
                if i not in names:
                    names[i] = (b"%d" % i, enc.tokenizer.id_to_token(i).encode())
            pairs = [names[i] for i in numbers]
            return b" ".join([p[0] for p in pairs]), b" ".join([p[1] for p in pairs])

        return form

    def encode(batches):
        enc = encoder("text", SparkFiles.get(tokenizer), SparkFiles.get(lexicon), form_for)
        for batch in batches:
            n_tokens, first, second = [], [], []
            for texts in text_slices(batch.column(1)):
                split = [t.split() for t in texts]
                memo = enc.learn(split)
                for words in split:
                    # words without a token (white space of other kinds alone) give an empty form and no separator
                    parts = [p for p in map(memo.__getitem__, words) if p[0]]
                    ids = b" ".join([p[0] for p in parts])
                    text = b" ".join([p[1] for p in parts])
                    n_tokens.append(ids.count(b" ") + 1 if ids else 0)
                    first.append(hashlib.sha256(ids).hexdigest() if digests else [int(x) for x in ids.split()])
                    second.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"]
            )

    kind = "string" if digests else "array<int>"
    out = docs.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids {kind}, decoded string")
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digests else out


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
