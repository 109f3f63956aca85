"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together anew.

A text's units are its maximal runs of ASCII letters and every other code point.  One
Aho-Corasick automaton reads a text once and reports only events: places where letters
and other characters meet, and sentinels.  Between two events lies one run, which is one
unit if it is of letters and as many units as code points if not.  So units are counted by
arithmetic over runs, and the place after k units is a binary search over their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.llm.chunks import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # of 100: texts that stay as they are
SPM_BELOW = 20  # of 100: suffix first
EVENT_BLOCK = 1 << 20  # code points scanned at a time

_LETTER, _OTHER = "a", "."
_KEPT = {ord(c): c for s in (PREFIX, SUFFIX, MIDDLE) for c in s}
#: Characters as the automaton sees them: those of the sentinels stay, others give way to their class.
_SEEN = bytes(ord(_KEPT.get(i, _LETTER if chr(i).isascii() and chr(i).isalpha() else _OTHER)) for i in range(256))


def _scanner() -> ahocorasick.Automaton:
    """Patterns: every letter-other pair, both ways (value 0), and the sentinels (value 1)."""
    letters = sorted({_LETTER} | {c for c in _KEPT.values() if c.isalpha()})
    others = sorted({_OTHER} | {c for c in _KEPT.values() if not c.isalpha()})
    a = ahocorasick.Automaton()
    for x in letters:
        for y in others:
            a.add_word(x + y, 0)
            a.add_word(y + x, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, 1)
    a.make_automaton()
    return a


_SCANNERS: list[ahocorasick.Automaton] = []


def scanner() -> ahocorasick.Automaton:
    """The automaton, built once in a worker process."""
    if not _SCANNERS:
        _SCANNERS.append(_scanner())
    return _SCANNERS[0]


class Units:
    """Where the units of a text end, held as one number a run."""

    def __init__(self, text: str):
        # one byte for each code point; whatever is not ASCII is no letter and becomes '?'
        seen = text.encode("ascii", "replace").translate(_SEEN).decode("ascii")
        changes, self.sentinel = [], False
        for at in range(0, len(seen), EVENT_BLOCK):
            # three characters of the block before, so that no pattern is cut; its own events come first
            lead = max(at - 3, 0)
            events = np.array(list(scanner().iter(seen, lead, min(at + EVENT_BLOCK, len(seen)))), dtype=np.int64).reshape(-1, 2)
            events = events[events[:, 0] >= at]
            self.sentinel |= bool(events[:, 1].any())
            changes.append(events[events[:, 1] == 0, 0])
        self.starts = np.concatenate([np.zeros(min(len(seen), 1), dtype=np.int64), *changes])
        lengths = np.diff(self.starts, append=len(seen))
        is_letter = np.arange(len(lengths)) % 2 == (0 if seen[:1].isalpha() else 1)
        self.letter = is_letter
        self.ends = self.starts + lengths
        self.sums = np.cumsum(np.where(is_letter, 1, lengths))
        self.n = int(self.sums[-1]) if len(self.sums) else 0

    def place(self, k: int) -> int:
        """Code points taken by the first k units."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.sums, k))
        if self.letter[run]:
            return int(self.ends[run])
        return int(self.starts[run]) + k - (int(self.sums[run - 1]) if run else 0)


def infill(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = Units(text)
    if not text or units.sentinel or h3 % 100 >= PLAIN_FROM:
        return units.n, "plain", None, None, text
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    i, j = units.place(a), units.place(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < SPM_BELOW:
        return units.n, "spm", i, j - i, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return units.n, "psm", i, j - i, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            ids = batch.column("doc_id")
            rows = [infill(i, t) for i, t in zip(ids.to_pylist(), batch.column("text").to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch(
                {
                    "doc_id": ids.cast(pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "form": pa.array(form, pa.string()),
                    "prefix_chars": pa.array(prefix, pa.int64()),
                    "middle_chars": pa.array(middle, pa.int64()),
                    "output": pa.array(output, pa.string()),
                }
            )


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """Every document of ``docs(doc_id, text)`` in its infilling form.

    Returns doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars
    (code points, null if plain) and output.  The cuts and the form follow from doc_id
    alone, so reruns agree and repeated ids are cut alike.  Null texts count as empty;
    empty texts and texts that hold a sentinel stay plain; a null id hashes as no digits.
    Other columns are ignored, and an empty table gives no rows.  Rows need not meet, so
    nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text again, from output and form.

    Texts with sentinels are plain, so each sentinel of an output stands once: a sentinel
    opens with the one character that none of them holds further on, so neither do a part's
    end and a sentinel's start make up another one.
    """
    psm, spm = F.split(output, f"{SUFFIX}|{MIDDLE}", -1), F.split(output, f"{PREFIX}|{MIDDLE}", -1)
    head = lambda parts: F.substr(F.get(parts, F.lit(0)), F.lit(len(PREFIX) + 1))
    return (
        F.when(form == "psm", F.concat(head(psm), F.get(psm, F.lit(2)), F.get(psm, F.lit(1))))
        .when(form == "spm", F.concat(F.get(spm, F.lit(1)), F.get(spm, F.lit(2)), head(spm)))
        .otherwise(output)
    )


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), t as (
  select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
    ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
    ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4
  from d
), c as (
  select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::bigint as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::bigint as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from t
), p as (
  select *, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:], '') as suf from c
)
select doc_id, n, form,
  case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
