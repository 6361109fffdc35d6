"""Three-way merge of branches as path-value cells.

A version of a table is a set of cells. A cell has a path - the row, ``place`` and ``gap`` - and a value. Places: -3 is the
row itself, -2 its lang, -1 its source, 0, 1, ... its lines; the gap at a line's place stands after the line and holds what
is inserted there. A row that a branch adds is one cell with the whole row as its value. The base version has all cells;
a branch has those that it wrote: a cell that it left out is as in base, one that is not ``there`` was dropped. (A branch
may also list cells that equal base; only values count.)

The cells of all versions are dealt by row once, grouped by path and pivoted to a base, a left and a right state, resolved
cell by cell, and put together again in the order of their places. All steps follow the one dealing: no second shuffle, no
join. A path has three cells at most, and a row's cells are those of one text, so that no group grows with the table.

Resolution: a change of one side, or the same change of both, is clean; else it is a conflict and the right state is
taken. Conflicts are insert-insert where base has no such cell, edit-delete where one side dropped it, else edit-edit. A
dropped row counts alone: as an edit-delete conflict if the other branch keeps it and changed any of its columns, lines or
gaps, else as clean.

Cases: nulls are empty; a null doc_id counts as empty text in the codes of its edits and stays null. An empty text is one
empty line. Rows that repeat a doc_id are merged each, and so is a row that is added under an id that is in use. Extra
columns are dropped. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.llm.common import as_documents

ROW, LANG, SOURCE = -3, -2, -1
LEFT, RIGHT = "L", "R"
DROP, MARK, OTHER_MARK, INSERT, OTHER_INSERT = range(5)
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
WHOLE = "lang string, source string, text string"


def edit_code(branch: str, doc_id: Column, name: Column) -> Column:
    """What a branch does to a cell: crc32 of `branch:doc_id:name` modulo 7; codes from 5 on do nothing."""
    path = F.concat(F.lit(f"{branch}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), name)
    return F.crc32(path.cast("binary")) % 7


def cells(docs: DataFrame, code: Callable[[str, Column, Column], Column] = edit_code) -> DataFrame:
    """Cells of base and of both branches: row, doc_id, added, place, gap, version, there, value.

    Each base cell and what the branches make of it come from one pass over the texts; ``code`` gives the edits."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = F.concat(F.array(F.lit(""), text("lang"), text("source")), F.split(text("text"), "\n", -1))
    docs = as_documents(docs, "doc_id", "text", "lang", "source")
    columns = [F.monotonically_increasing_id().alias("row"), "doc_id", text("lang").alias("lang"), text("source").alias("source")]
    # Rows are numbered before they are taken apart.
    base = docs.select(*columns, parts.alias("parts"))
    base = base.select("row", "doc_id", "lang", "source", F.posexplode("parts").alias("place", "value")).withColumn("place", F.col("place") + ROW)
    is_row, is_line = F.col("place") == ROW, F.col("place") >= 0
    names = F.when(is_row, F.lit("row")).when(F.col("place") == LANG, F.lit("lang")).when(F.col("place") == SOURCE, F.lit("source"))
    names = names.otherwise(F.col("place").cast("string"))
    base = base.select("*", *[code(b, F.col("doc_id"), names).alias(b) for b in (LEFT, RIGHT)])

    def cell(version: str, there: bool, value: Column, added: bool = False, gap: bool = False) -> Column:
        flags = ((version, "version"), (there, "there"), (added, "added"), (gap, "gap"))
        return F.struct(*[F.lit(v).alias(n) for v, n in flags], value.cast("string").alias("value"))

    def edited(branch: str) -> Column:
        is_ = F.col(branch).isin
        mark = F.when(is_(MARK, INSERT), F.lit("!")).otherwise(F.lit("?"))
        whole = F.to_json(F.struct("lang", "source", mark.alias("text")))
        return (
            F.when(is_(DROP) & (is_row | is_line), cell(branch, False, F.lit(None)))
            .when(is_(DROP), cell(branch, True, F.lit("")))
            .when(is_(MARK, OTHER_MARK) & ~is_row, cell(branch, True, F.concat("value", mark)))
            .when(is_(INSERT, OTHER_INSERT) & is_line, cell(branch, True, mark, gap=True))
            .when(is_(INSERT, OTHER_INSERT) & is_row, cell(branch, True, whole, added=True))
        )

    versions = F.array_compact(F.array(cell("", True, F.col("value")), edited(LEFT), edited(RIGHT)))
    return base.select("row", "doc_id", "place", F.inline(versions))


def resolve(pivoted: DataFrame) -> DataFrame:
    """Of each path's three states: what each side changed, the kind of its merge, and the states merged and right."""
    there = F.coalesce("in_base", F.lit(False))
    state = lambda v: F.when(F.coalesce(F.col(f"in_{v}"), there), F.when(F.col(f"in_{v}").isNull(), F.col("base")).otherwise(F.col(v)))
    step = pivoted.select("*", *[state(v).alias(f"now_{v}") for v in (LEFT, RIGHT)], F.when(there, F.col("base")).alias("was"))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    step = step.select(
        "*", differs("now_L", "was").alias("by_left"), differs("now_R", "was").alias("by_right"), differs("now_L", "now_R").alias("apart")
    )
    conflict = F.col("by_left") & F.col("by_right") & F.col("apart")
    some = F.col("by_left") | F.col("by_right")
    kind = F.when(some & ~conflict, F.lit(0)).when(some & F.col("was").isNotNull() & F.col("now_L").isNotNull() & F.col("now_R").isNotNull(), F.lit(1))
    kind = kind.when(some & F.col("was").isNotNull(), F.lit(2)).when(some, F.lit(3))
    left_alone = F.col("by_left") & ~F.col("by_right")
    merged = F.when(left_alone, F.col("now_L")).otherwise(F.col("now_R"))
    path = ("row", "doc_id", "added", "place", "gap", "by_left", "by_right")
    # Both states differ only where the left one is taken.
    return step.select(*path, kind.alias("kind"), merged.alias("merged"), left_alone.alias("own"), F.when(left_alone, F.col("now_R")).alias("right"))


def merge(versions: DataFrame) -> DataFrame:
    """doc_id, lang, source, text (null where the row is gone) and the counts of every row that any version has."""
    dealt = versions.repartition("row")
    in_, of = lambda v: F.when(F.col("version") == v, F.col("there")), lambda v: F.when(F.col("version") == v, F.col("value"))
    names = (("", "base"), (LEFT, LEFT), (RIGHT, RIGHT))
    pivoted = dealt.groupBy("row", "added", "place", "gap").agg(
        F.max("doc_id").alias("doc_id"), *[f for v, n in names for f in (F.max(in_(v)).alias(f"in_{n}"), F.max(of(v)).alias(n))]
    )
    done = resolve(pivoted)
    is_row, inner = (F.col("place") == ROW) & ~F.col("added"), F.col("place") > ROW
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    both = F.struct("merged", "own", "right")
    at = lambda place, added=False: F.max(F.when((F.col("place") == place) & (F.col("added") == added), both))
    rows = done.groupBy("row", "added").agg(
        F.max("doc_id").alias("doc_id"),
        *[F.count_if((F.col("kind") == k) & ~is_row).alias(n) for k, n in enumerate(COUNTS)],
        any_(is_row & F.col("by_left")).alias("left_drops"),
        any_(is_row & F.col("by_right")).alias("right_drops"),
        any_(inner & F.col("by_left")).alias("left_edits"),
        any_(inner & F.col("by_right")).alias("right_edits"),
        at(LANG).alias("lang"),
        at(SOURCE).alias("source"),
        at(ROW, True).alias("whole"),
        F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "gap", "merged", "own", "right"))).alias("lines"),
    )
    clash = (F.col("left_drops") & ~F.col("right_drops") & F.col("right_edits")) | (F.col("right_drops") & ~F.col("left_drops") & F.col("left_edits"))
    drops = F.col("left_drops") | F.col("right_drops")
    gone = F.col("right_drops") | (F.col("left_drops") & ~F.col("right_edits"))
    rows = rows.select("*", clash.alias("clash"), drops.alias("drops"), gone.alias("gone"), F.from_json("whole.merged", WHOLE).alias("new"))
    # Where the left branch dropped the row and the right one edited it, the right state stands.
    pick = lambda s: F.when(F.col("drops") & s["own"], s["right"]).otherwise(s["merged"])
    text = F.array_join(F.transform(F.sort_array("lines"), pick), "\n")
    made = lambda c, old: F.when(F.col("added"), F.col(f"new.{c}")).when(~F.col("gone"), old).alias(c)
    counts = [F.col(c) for c in COUNTS]
    alone = [(~F.col("clash")).cast("long"), F.lit(0), F.col("clash").cast("long"), F.lit(0)]
    return rows.select(
        F.when(F.col("added"), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        made("lang", pick(F.col("lang"))),
        made("source", pick(F.col("source"))),
        made("text", text),
        *[F.when(F.col("drops"), a).otherwise(c).cast("long").alias(n) for a, c, n in zip(alone, counts, COUNTS)],
    )


def merged(docs: DataFrame) -> DataFrame:
    """The merge of branches L and R of a document table, with the digest of each text."""
    out = merge(cells(docs))
    return out.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *COUNTS)


def duckdb_sql() -> str:
    """The same merge without cells: branches are applied to whole lines and columns side by side."""
    return r"""
with steps as (
  select i, list_reduce(list_prepend(i, range(0, 8)),
    lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
  from (select unnest(range(0, 256)) as i)),
crc as (select list(c order by i) as tab from steps),
d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang,
    coalesce(source, '') as source from documents),
named as (
  select rid, doc_id, 'row' as name, '' as v, -3 as place from d
  union all select rid, doc_id, 'lang', lang, -2 from d
  union all select rid, doc_id, 'source', source, -1 from d
  union all select rid, doc_id, cast(place as varchar), v, place from (
    select rid, doc_id, unnest(string_split(text, chr(10))) as v,
      unnest(range(0, len(string_split(text, chr(10))))) as place from d)),
coded as (
  select rid, doc_id, place, v, b,
    xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(b || ':' || coalesce(cast(doc_id as varchar), '') || ':' || name, ''), lambda x: cast(ascii(x) as bigint))),
      lambda a, x: xor(tab[cast(xor(a, x) & 255 as integer) + 1], a >> 8)), 4294967295) % 7 as code
  from named, crc, (select unnest(['L', 'R']) as b)),
side as (
  select rid, doc_id, place, v, l.code as lc, r.code as rc
  from (select * from coded where b = 'L') l join (select rid, place, code from coded where b = 'R') r using (rid, place)),
state as (
  select *,
    case when lc = 0 then case when place >= 0 then null else '' end when lc in (1, 2) then v || case lc when 1 then '!' else '?' end else v end as ln,
    case when rc = 0 then case when place >= 0 then null else '' end when rc in (1, 2) then v || case rc when 1 then '!' else '?' end else v end as rn,
    case when place >= 0 then case lc when 3 then '!' when 4 then '?' end end as lg,
    case when place >= 0 then case rc when 3 then '!' when 4 then '?' end end as rg
  from side where place > -3),
judged as (
  select *, ln is distinct from v as lch, rn is distinct from v as rch, ln is distinct from rn as apart from state),
summed as (
  select rid,
    sum(cast((lch or rch) and not (lch and rch and apart) as int) + cast((lg is not null or rg is not null) and not coalesce(lg <> rg, false) as int)) as clean,
    sum(cast(lch and rch and apart and ln is not null and rn is not null as int)) as ee,
    sum(cast(lch and rch and apart and (ln is null or rn is null) as int)) as ed,
    sum(cast(coalesce(lg <> rg, false) as int)) as ii,
    bool_or(lch or lg is not null) as led, bool_or(rch or rg is not null) as red,
    max(case when place = -2 then case when lch and not rch then ln else rn end end) as mlang,
    max(case when place = -1 then case when lch and not rch then ln else rn end end) as msource,
    max(case when place = -2 then rn end) as rlang, max(case when place = -1 then rn end) as rsource,
    string_agg(case when place < 0 then null else concat_ws(chr(10), case when lch and not rch then ln else rn end, coalesce(rg, lg)) end, chr(10) order by place)
      filter (where place >= 0 and ((case when lch and not rch then ln else rn end) is not null or coalesce(rg, lg) is not null)) as mtext,
    string_agg(concat_ws(chr(10), rn, rg), chr(10) order by place) filter (where place >= 0 and (rn is not null or rg is not null)) as rtext
  from judged group by rid),
rows as (select rid, lc, rc from side where place = -3),
old as (
  select d.doc_id, lc = 0 as ld, rc = 0 as rd, (lc = 0 and rc <> 0 and red) or (rc = 0 and lc <> 0 and led) as clash, s.*
  from d join rows using (rid) join summed s using (rid))
select doc_id,
  case when rd or (ld and not red) then null when ld then rlang else mlang end as lang,
  case when rd or (ld and not red) then null when ld then rsource else msource end as source,
  case when rd or (ld and not red) then null when ld then sha256(coalesce(rtext, '')) else sha256(coalesce(mtext, '')) end as text_sha256,
  cast(case when ld or rd then case when clash then 0 else 1 end else clean end as bigint) as n_clean,
  cast(case when ld or rd then 0 else ee end as bigint) as n_edit_edit,
  cast(case when ld or rd then case when clash then 1 else 0 end else ed end as bigint) as n_edit_delete,
  cast(case when ld or rd then 0 else ii end as bigint) as n_insert_insert
from old
union all
select -1 - doc_id, lang, source, sha256(case when rc = 3 or (rc <> 4 and lc = 3) then '!' else '?' end),
  cast(case when lc in (3, 4) and rc in (3, 4) and lc <> rc then 0 else 1 end as bigint), 0, 0,
  cast(case when lc in (3, 4) and rc in (3, 4) and lc <> rc then 1 else 0 end as bigint)
from d join rows using (rid) where lc in (3, 4) or rc in (3, 4)
"""
