"""Line dedup with content-defined chunks of lines.

A hash rolls over the hashes of each two neighbouring lines.  A boundary stands wherever the
rolling hash is new to the corpus, so boundaries hang on content alone and come back into step
right after an insertion, and a chunk is a longest run of lines whose every step was there
before, by doc_id and then line.  Each step of a chunk, two lines, is compared byte by byte
with its first occurrence before the chunk goes.

So every repeated passage of two lines or more is found, wherever it stands in its texts; and
since a line's first occurrence in the corpus lies in no repeated step, no line is lost to all
texts.  Of one line repeated on end, one is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle

MIN_LINES = 2
COPIES_A_TASK = 4096  # a step with more copies is compared in several tasks


def _let(value: Column, body) -> Column:
    """Bind ``value`` once, as a lambda variable, so that it is not worked out per element."""
    return F.transform(F.array(value), body)[0]


def rolling_steps(lines: Column, width: int) -> Column:
    """array<struct<start,key>>: the rolling hash of each ``width`` lines, 1-based, but for blank ones."""
    hashes = F.transform(lines, lambda x: F.md5(x.cast("binary")))

    def rolled(x: Column) -> Column:
        places = F.when(F.size(x["l"]) >= width, F.sequence(F.lit(1), F.size(x["l"]) - width + 1)).otherwise(F.array().cast("array<int>"))
        places = F.filter(places, lambda i: F.exists(F.slice(x["l"], i, width), lambda y: F.trim(y) != ""))
        key = lambda i: F.unhex(F.md5(F.array_join(F.slice(x["h"], i, width), "").cast("binary")))
        return F.transform(places, lambda i: F.struct(i.alias("start"), key(i).alias("key")))

    return _let(F.struct(lines.alias("l"), hashes.alias("h")), rolled)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_mark", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))


def repeated_steps(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Steps of ``docs(doc_id, text)`` that occurred before: rows (doc_id, mark, start).

    ``mark`` is the MD5 of the text, so rows that repeat a doc_id keep apart unless their
    texts are equal too; such rows are treated alike.
    """
    lines = _marked(docs.select("doc_id", "text")).filter(F.col("text").contains("\n")).select("doc_id", F.col("_mark").alias("mark"), F.split("text", "\n", -1).alias("lines"))
    steps = settle(lines.select("doc_id", "mark", F.explode(rolling_steps(F.col("lines"), min_lines)).alias("s")).select("doc_id", "mark", "s.*"), "steps")
    again = steps.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "mark")).alias("keep")).filter("c > 1")
    again = again.select("key", "keep", F.ceil(F.col("c") / COPIES_A_TASK).cast("int").alias("parts"))
    # only texts with a repeated step are opened again, for the byte comparison
    spots = steps.join(again, "key").withColumn("kept", (F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))) & (F.col("start") == F.col("keep.start")) & (F.col("mark") == F.col("keep.mark")))
    wanted = spots.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "key", "kept", "parts")).alias("spots"))
    d = _marked(docs.select("doc_id", "text")).alias("d")
    # merge: what is wanted grows with the corpus, so the plan is the shuffled one at every size
    opened = d.join(wanted.hint("merge").alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("_mark") == F.col("mark")))
    bodies = (
        opened.select("d.doc_id", "mark", F.split("text", "\n", -1).alias("lines"), F.explode("spots").alias("s"))
        .select("doc_id", "mark", "s.*", F.array_join(F.slice("lines", F.col("s.start"), min_lines), "\n").alias("body"))
    )
    bodies = settle(bodies, "bodies")
    discard(steps)
    # the first occurrence goes to each of the tasks that its copies are dealt to
    first = bodies.filter("kept").groupBy("key").agg(F.min("body").alias("first"), F.max("parts").alias("parts"))
    first = first.select("key", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    later = bodies.filter("not kept").withColumn("part", F.pmod(F.xxhash64("doc_id", "mark", "start"), F.col("parts")).cast("int"))
    gone = settle(later.join(first, ["key", "part"]).filter(F.col("body") == F.col("first")).select("doc_id", "mark", "start"), "gone")
    discard(bodies)
    return gone


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with repeated chunks of ``min_lines`` lines or more taken out of ``text``; all rows and columns stay.

    The first occurrence of a chunk, by doc_id then line, stays.  Texts without a line
    break, empty and null texts come back as they are, and so does an empty table; chunks
    of blank lines (empty or of spaces) are left alone.  Two columns follow those of ``docs``:
    _removed_chunks and _removed_lines.  Other columns may have any names but these two.
    """
    told = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = [F.col(told.get(c, c)).alias(c) for c in docs.columns]
    docs = docs.select(*[F.col(f"`{c}`").alias(told.get(c, c)) for c in docs.columns])
    # numbers of the removed lines of each text, and how many runs they form
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + min_lines - 1)))))
    runs = lambda n: F.size(F.filter(n, lambda x, i: (i == 0) | (x - F.get(n, i - 1) > 1)))
    by = repeated_steps(docs, min_lines).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_m")).agg(F.collect_set("start").alias("starts"))
    by = by.select("_id", "_m", _let(numbers, lambda n: F.struct(n.alias("gone"), runs(n).alias("runs"))).alias("x")).select("_id", "_m", F.col("x.gone").alias("_gone"), F.col("x.runs").alias("_runs"))
    d = _marked(docs)
    joined = d.join(by.hint("merge"), d["doc_id"].eqNullSafe(by["_id"]) & (d["_mark"] == by["_m"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("_gone"))), lambda i: F.struct(i.alias("i")))
    text = F.transform(F.array(F.struct(lines.alias("l"), kept.alias("k"))), lambda x: F.array_join(F.transform(x["k"], lambda i: F.element_at(x["l"], i["i"])), "\n"))[0]
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(text))
    return out.select(*back, F.coalesce("_runs", F.lit(0)).alias("_removed_chunks"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("_removed_lines"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id",
        F.col("_removed_chunks").cast("long").alias("removed_chunks"),
        F.col("_removed_lines").cast("long").alias("removed_lines"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


OP3_SQL = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where contains(text, chr(10))
), w as (
  select doc_id, i, line, lead(line) over (partition by doc_id order by i) as next, lead(i) over (partition by doc_id order by i) is not null as pair from l
), r as (
  select doc_id, i, row_number() over (partition by line, next order by doc_id, i) > 1 as later from w where pair and (trim(line) <> '' or trim(next) <> '')
), g as (
  select l.doc_id, l.i, l.line, coalesce(a.later, false) or coalesce(b.later, false) as gone
  from l left join r a on a.doc_id = l.doc_id and a.i = l.i left join r b on b.doc_id = l.doc_id and b.i = l.i - 1
), t as (
  select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as text from g group by doc_id having bool_or(gone)
), s as (
  select doc_id, count_if(gone and not before) as removed_chunks, count_if(gone) as removed_lines
  from (select *, coalesce(lag(gone) over (partition by doc_id order by i), false) as before from g) group by doc_id
)
select d.doc_id, coalesce(s.removed_chunks, 0) as removed_chunks, cast(coalesce(s.removed_lines, 0) as bigint) as removed_lines,
  length(coalesce(t.text, d.text)) as kept_chars, md5(coalesce(t.text, d.text)) as kept_md5
from documents d left join s on s.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""
