"""License scans by conditional compression.

Cue words locate the places: the words around a cue, ``1 + SPREAD`` times the longest template on both sides,
are a candidate block, and blocks that touch are one. A block is compressed alone and with every template as a
raw zstandard dictionary, and templates are ranked by the bytes they save. They are confirmed by wording, best
first; none is left out by its rank, since a short notice in a long block may save next to nothing there. The
template is aligned with the words of the block by an exact dynamic program (template words may be missing, other words may be added), so line
breaks, comment marks and sentences around a notice do not matter. An alignment that lacks few enough
words, none of them with a digit, is compressed again without the words around it: the share saved is what the
template explains. Where alignments overlap, the template
that saves most bytes is the finding (a missing word counts as ``LACKS`` bytes, or as as many added words); the words
left over are a block again, until no template is confirmed, so lists of licenses give one finding for each notice.

Words added to a notice are at most ``SPREAD`` times its own; templates of fewer than ``SHORT``
words hold no foreign sentence start, and no version number is read across another number.
The cue words occur in every built-in template, also when wrapped (tested); a template given without one adds its
rarest words as cues, one more than a notice may lack. The cost is linear in the words of the
regions. Everything is one map-only pass.

Defined results: null and empty texts have no findings. Positions are code points, end
exclusive. Rows that repeat an id are scanned one by one; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.license_templates import TEMPLATES

CUES = (r"(?i)licen[sc]e|copyright|permi(?:ssion|tted)|redistribut|public\W+(?:\w{1,3}\W+)?domain|\bCC[ 0]|"
        r"Creative Commons|\bMPL\b")
WORD = re.compile(r"\w+(?:(?:\.|-(?:[ \t]*\n\W*(?:(?i:dnl|rem)\W+)?)?)\w+)*")
WRAP = re.compile(r"\s*\n\W*(?:(?i:dnl|rem)\W+)?")
SENTENCE = re.compile(r"[.!?]\W*\s|\n\s*\n")
SPREAD = 3
SHORT = 20
LACKS = 4
MIN_SAVING = 0.25
MAX_MISSING = 0.1
NEVER = 1 << 32


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    license: str
    saving: float
    missing: int
    added: int
    wording: str


def words_of(text: str) -> list[str]:
    return [WRAP.sub("", m) for m in WORD.findall(text.lower())]


def cue_pattern(templates) -> str:
    """The cue regex (alike in Python and Java) that holds for these templates."""
    seen: dict[str, int] = {}
    for _, text in templates:
        for w in words_of(text):
            seen[w] = seen.get(w, 0) + 1
    extra = set()
    for _, text in templates:
        if not re.search(CUES, text):
            words = sorted(set(words_of(text)), key=lambda w: (seen[w], -len(w), w))
            extra.update(words[:int(MAX_MISSING * len(words_of(text))) + 1])
    return "|".join([CUES, *(rf"\b{re.escape(w)}\b" for w in sorted(extra))])


class Template:
    def __init__(self, name: str, text: str, vocabulary: dict[str, int]):
        import zstandard as zs

        d = zs.ZstdCompressionDict(text.encode(), dict_type=zs.DICT_TYPE_RAWCONTENT)
        self.name, self.words, self.tail = name, words_of(text), re.search(r"\W*\Z", text).group()
        self.press = zs.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False,
                                       write_dict_id=False)
        self.ids = [vocabulary.setdefault(w, len(vocabulary)) for w in self.words]
        self.allowed = int(MAX_MISSING * len(self.words))
        self.fixed = [any(ch.isdigit() for ch in w) for w in self.words]

    def possible(self, present: set[int]) -> bool:
        """Whether enough of the words occur at all."""
        lacks = [f for i, f in zip(self.ids, self.fixed) if i not in present]
        return len(lacks) <= self.allowed and not any(lacks)

    def align(self, ids: np.ndarray, breaks: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(differences, lacking, start, end) of the best alignment at every end word that has one, in words.
        cost[m, j]: least number of added words of an alignment that ends before word j and lacks m words."""
        n, size = len(self.words), len(ids)
        free = np.arange(size + 1)
        bound = np.concatenate(([0], np.cumsum(np.where(breaks, NEVER, 1))))
        cost = np.full((self.allowed + 1, size + 1), NEVER)
        cost[0] = 0
        for i, (w, fixed) in enumerate(zip(self.ids, self.fixed)):
            after = np.full_like(cost, NEVER)
            hit = np.flatnonzero(ids == w)
            after[:, hit + 1] = cost[:, hit]
            if not fixed:
                np.minimum(after[1:], cost[:-1], out=after[1:])
            if i + 1 < n:
                run = bound if n < SHORT or self.words[i + 1][0].isdigit() else free
                after = run + np.minimum.accumulate(after - run, axis=1)
            cost = after
        total = cost + LACKS * np.arange(self.allowed + 1)[:, None]
        m = total.argmin(axis=0)
        least = total.min(axis=0)
        good = least - LACKS * m <= SPREAD * n
        good[1:] &= least[1:] <= least[:-1]  # else it only adds a word behind a shorter one
        return [(int(least[j]), int(m[j]), int(j - (n - m[j]) - (least[j] - LACKS * m[j])), int(j))
                for j in np.flatnonzero(good)]


class Scanner:
    def __init__(self, templates=TEMPLATES):
        import zstandard as zs

        self.plain = zs.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.vocabulary: dict[str, int] = {}
        self.templates = [Template(name, text, self.vocabulary) for name, text in templates]
        self.reach = (1 + SPREAD) * max(len(t.words) for t in self.templates)
        self.cue = re.compile(cue_pattern(templates))

    def regions(self, text: str) -> Iterator[list[re.Match]]:
        """The words around the cues."""
        cues = [m.span() for m in self.cue.finditer(text)]
        if not cues:
            return
        words = list(WORD.finditer(text))
        starts = np.array([m.start() for m in words])
        first = np.searchsorted(starts, [a for a, _ in cues], "right") - 1 - self.reach
        last = np.searchsorted(starts, [b for _, b in cues]) + self.reach
        a, b = max(0, int(first[0])), int(last[0])
        for x, y in zip(first.tolist(), last.tolist()):
            if x > b:
                yield words[a:b]
                a = x
            b = y
        yield words[a:b]

    def scan(self, text: str | None) -> list[Finding]:
        out = []
        for words in self.regions(text or ""):
            plain = [WRAP.sub("", m.group()).lower() for m in words]
            ids = np.array([self.vocabulary.get(w, -1) for w in plain])
            breaks = np.array([w[0].isdigit() for w in plain])
            for k in range(1, len(words)):
                gap = text[words[k - 1].end():words[k].start()]
                if len(gap) > 1 and SENTENCE.search(gap) and (words[k].group()[0].isupper() or "\n" in gap):
                    breaks[k] = True
            rest = [(0, len(words))]
            while rest:
                a, b = rest.pop()
                ranked = self._ranked(text[words[a].start():words[b - 1].end()])
                taken = self._confirmed(text, words, ids, breaks, a, b, ranked)
                for t, start, end, lo, hi, saving in taken:
                    missing, added, wording = differences(t.words, plain[start:end])
                    out.append(Finding(lo, hi, t.name, round(saving, 4), len(missing), len(added), wording))
                if taken:
                    edges = [a, *[x for _, s, e, *_ in taken for x in (s, e)], b]
                    rest += [(x, y) for x, y in zip(edges[::2], edges[1::2]) if x < y]
        return sorted(out, key=lambda f: f.start)

    def _ranked(self, block: str) -> list[int]:
        """Numbers of the templates, those that shorten the compressed block most first."""
        data = WRAP.sub(" ", block).encode()
        return [no for _, no in sorted((len(t.press.compress(data)), no) for no, t in enumerate(self.templates))]

    def _confirmed(self, text, words, ids, breaks, a: int, b: int, ranked: list[int]) -> list[tuple]:
        """(template, first word, end word, start, end, saving) of notices among words a to b that do
        not overlap, in text order."""
        found = []
        present = set(ids[a:b].tolist())
        for no in ranked:
            t = self.templates[no]
            if not t.possible(present):
                continue
            used = np.zeros(b - a, bool)
            for differ, lacks, s, e in sorted(t.align(ids[a:b], breaks[a:b]), key=lambda x: (x[0], x[3] - x[2], x[2])):
                if used[s:e].any():
                    continue
                lo, hi = words[a + s].start(), words[a + e - 1].end()
                hi += len(t.tail) if text.startswith(t.tail, hi) else 0
                data = WRAP.sub(" ", text[lo:hi]).encode()
                alone, given = len(self.plain.compress(data)), len(t.press.compress(data))
                if 1 - given / alone >= MIN_SAVING:
                    used[s:e] = True
                    found.append((given - alone + LACKS * lacks, differ, no, a + s, a + e, lo, hi, 1 - given / alone))
        used, taken = np.zeros(b - a, bool), []
        for _, _, no, s, e, lo, hi, saving in sorted(found):
            if not used[s - a:e - a].any():
                used[s - a:e - a] = True
                taken.append((self.templates[no], s, e, lo, hi, saving))
        return sorted(taken, key=lambda x: x[1])


def differences(wanted: list[str], words: list[str]) -> tuple[list[str], list[str], str]:
    """(template words the block lacks, words it has instead, both as text) of the best
    alignment; words before and after the notice are not differences."""
    if wanted == words:
        return [], [], ""
    best = [[0] * (len(words) + 1) for _ in range(len(wanted) + 1)]  # most words in common from (i, j) on
    for i in range(len(wanted) - 1, -1, -1):
        for j in range(len(words) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if wanted[i] == words[j] else max(best[i + 1][j], best[i][j + 1])
    missing, added, wording, i, j, met = [], [], [], 0, 0, False
    while i < len(wanted):
        if j < len(words) and wanted[i] == words[j]:
            i, j, met = i + 1, j + 1, True
        elif j < len(words) and best[i][j + 1] == best[i][j] and best[i][j]:
            if met:
                added.append(words[j])
                wording.append(f"+{words[j]}")
            j += 1
        else:
            missing.append(wanted[i])
            wording.append(f"-{wanted[i]}")
            i += 1
    return missing, added, " ".join(wording)


def _scan(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for k, t in enumerate(b.column(1)):
                rows += [(k, f) for f in scanner.scan(t.as_py())]
            if rows:
                at = pa.array([k for k, _ in rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), *[pa.array([getattr(f, c) for _, f in rows], t) for c, t in (
                        ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saving", pa.float64()),
                        ("missing", pa.int64()), ("added", pa.int64()), ("wording", pa.string()))]],
                    names=["id", "license", "start", "end", "saving", "n_missing", "n_added", "wording"])
    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per finding: ``id_col``, license, start, end, saving (share of the compressed size
    that the template explains), n_missing, n_added, wording."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").rlike(cue_pattern(templates))) \
        .mapInArrow(_scan(templates), f"id {kind}, license string, start bigint, end bigint, saving double, "
                                      "n_missing bigint, n_added bigint, wording string")
    return found.withColumnRenamed("id", id_col)
