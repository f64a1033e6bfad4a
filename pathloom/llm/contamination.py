"""Passages of held-out evaluation items inside a corpus.

Items are cut into all their runs of ``words`` consecutive words (a shorter item
is one run); one Aho-Corasick automaton over word numbers, one node a word, holds every
run. Each document is scanned once, word by word, and hits are mapped back to offsets in
the original text. Words are runs of letters and digits, in lower case, so case,
punctuation, mark-up, line prefixes, spacing and line breaks make no difference; a word
that no item has takes the automaton back to its start.

The items are written to the shared folder, and each Python worker builds its automaton
from there: neither the driver nor a broadcast holds them. Items of more than
``max_words`` words in all are cut into blocks of that size; each block has an
automaton of its own and scans the corpus once, all blocks in one job. Documents are
never collected or shuffled. NULL and empty texts hold nothing; an item without
a word is no pattern; repeated items each get their own rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import ahocorasick
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.storage import Scratch, measured

WORD = re.compile(r"[^\W_]+")

#: Words of items in one automaton; a node for each of up to 12 words that follow one takes some 700 bytes an item word.
MAX_WORDS = 300_000

_AUTOMATA: dict[tuple, "Automaton"] = {}


class Automaton:
    """All runs of ``words`` words of some items, over numbered words."""

    def __init__(self, items: Sequence[tuple[int, str]], words: int):
        self.numbers: dict[str, int] = {}
        runs: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            w = [self.numbers.setdefault(m.group().lower(), len(self.numbers) + 1) for m in WORD.finditer(text or "")]
            n = min(words, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                hits = runs.setdefault(tuple(w[i : i + n]), [])
                if item not in hits:
                    hits.append(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, hits in runs.items():
            self.tree.add_word(run, (len(run), hits))
        self.size = len(runs)
        if runs:
            self.tree.make_automaton()

    def scan(self, doc: int, text: str) -> list[tuple[int, int, int, int]]:
        """(doc, item, begin, end) of the stretches of ``text`` that hold a passage of an item."""
        if not self.size:
            return []
        spans, line = [], []
        for m in WORD.finditer(text):
            spans.append(m.span())
            line.append(self.numbers.get(m.group().lower(), 0))
        if not any(line):
            return []
        stretches: dict[int, list[list[int]]] = {}
        for last, (n, hits) in self.tree.iter(tuple(line)):
            begin, end = spans[last - n + 1][0], spans[last][1]
            for item in hits:
                mine = stretches.setdefault(item, [])
                if mine and begin <= mine[-1][1]:
                    mine[-1][0] = min(mine[-1][0], begin)
                    mine[-1][1] = max(mine[-1][1], end)
                else:
                    mine.append([begin, end])
        return [(doc, item, b, e) for item, parts in sorted(stretches.items()) for b, e in parts]


def _automaton(path: str, block: int, words: int) -> Automaton:
    """The automaton of a block of the item table at ``path``, built once per Python worker."""
    key = (path, block, words)
    if key not in _AUTOMATA:
        fs, p = (pafs.LocalFileSystem(), urlparse(path).path) if urlparse(path).scheme in ("", "file") else pafs.FileSystem.from_uri(path)
        rows = pq.read_table(p, filesystem=fs, filters=[("block", "=", block)]).select(["item_id", "text"]).to_pylist()
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton([(r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: r["item_id"])], words)
    return _AUTOMATA[key]


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = 12, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, item_id, begin, end): stretches of a document's text that hold a passage of an item.

    Overlapping passages of one item are one stretch.
    """
    scratch = Scratch(documents.sparkSession, "items")
    held_out = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = F.size(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{Nd}]+)"), 1))
    held_out = scratch.cut(held_out, "items", words=F.sum(size))
    n_blocks = max(1, -(-(measured(held_out).get("words") or 0) // max_words))
    blocks = held_out.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))
    path = scratch.cut(blocks, "blocks")._pathloom_path
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = None
    for block in range(n_blocks):
        part = docs.mapInArrow(_scanner(path, block, words), "doc_id bigint, item_id bigint, begin int, end int")
        found = part if found is None else found.unionByName(part)
    return found


def _scanner(path: str, block: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(path, block, words)
        for b in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in automaton.scan(doc, text):
                    for column, x in zip(rows, row):
                        column.append(x)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "item_id", "begin", "end"])

    return run
