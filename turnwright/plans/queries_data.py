"""Queries on cells, merges, samples, uncertainty, rewards and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwright.functions import classify, nested
from turnwright.functions import semistructured as ss
from turnwright.functions import text as tx
from turnwright.functions import uncertainty as uq
from turnwright.operators import annotate, margins, merge, providers, reward, sampling, turns
from turnwright.plans.fixtures import fixture
from turnwright.plans.queries import _CM2, _LETTER, _SOURCE, _SUGGESTED, _TC, _THINK, _ANSWER, _CATEGORY, _any, _conversations, _CAND, _cut, _dumped, _marked, _turned, _RENDERED, _SURFACE, _TM, _FORMS, _FIRST, _E2, query
from turnwright.sources import io

# Semi-structured cells.


@query("""select event_id, case when not json_valid(cell) then 'invalid' when json_type(cell) = 'OBJECT' then 'object' when json_type(cell) = 'ARRAY' then 'array' else 'string' end as kind,
  case when json_valid(cell) then cast(json_extract_string(cell, '$.k') as bigint) end as k from json_cells""")
def b1_ensure_dict(spark, sf_dir):
    c = F.col("cell")
    return fixture(spark, sf_dir, "json_cells").select("event_id", ss.kind(c).alias("kind"), F.get_json_object(ss.ensure_object(c), "$.k").cast("long").alias("k"))


@query("""select event_id, cast(case when json_valid(cell) and json_type(cell) = 'ARRAY' then json_array_length(cell) else 0 end as bigint) as n from json_cells""")
def b2_ensure_list(spark, sf_dir):
    return fixture(spark, sf_dir, "json_cells").select("event_id", F.size(ss.ensure_array(F.col("cell"))).cast("long").alias("n"))


@query("""select event_id, case when json_valid(cell) then 'json' else cell end as value from json_cells""")
def b3_coerce(spark, sf_dir):
    c = F.col("cell")
    value = F.when(ss.parsed(c).isNotNull(), F.lit("json")).otherwise(ss.coerced(c))
    return fixture(spark, sf_dir, "json_cells").select("event_id", value.alias("value"))


@query("""select event_id, '{' || concat_ws(',', '"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '"', '"user_id":' || user_id, '"event_type":"' || event_type || '"', '"value":' || value,
  '"props":"' || replace(props, '"', '\\"') || '"') || '}' as cell from events""")
def b4_json_safe(spark, sf_dir):
    df = fixture(spark, sf_dir, "events")
    return df.select("event_id", F.to_json(F.struct("ts", "user_id", "event_type", "value", "props")).alias("cell"))


@query("select id, case when id % 5 = 2 then 'null' when json_valid(extra) then " + _dumped("extra") + " else extra end as value from extra_cells")
def b5_empty_objects(spark, sf_dir):
    return fixture(spark, sf_dir, "extra_cells").select("id", ss.without_empty_objects("extra").alias("value"))


@query("""select o_orderkey as id, cast(case o_orderkey % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 0 end as bigint) as n from orders""")
def b6_depends_on(spark, sf_dir):
    cell = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 1, "3").when(F.col("o_orderkey") % 4 == 2, '["a",2]').otherwise("null")
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.size(ss.normalized_depends(cell)).cast("long").alias("n"))


@query("""select id, case when tools is null then 'none' when json_valid(tools) then 'json' else tools end as value from tool_cells""")
def b7_parse_tools(spark, sf_dir):
    t = F.col("tools")
    value = F.when(t.isNull(), "none").when(ss.parsed(t).isNotNull(), "json").otherwise(t)
    return fixture(spark, sf_dir, "tool_cells").select("id", value.alias("value"))


_NAMES = """case cast(id % 6 as int) when 0 then 'f' || cast(id % 7 as varchar) when 1 then 'look_up,open' when 2 then 'single' else '' end"""


@query(f"""select id, {_NAMES} as names, cast(case cast(id % 6 as int) when 0 then 1 when 1 then 2 when 2 then 1 else 0 end as bigint) as n from tool_cells""")
def b8_openai_tools(spark, sf_dir):
    df = fixture(spark, sf_dir, "tool_cells").withColumn("t", F.coalesce(ss.openai_tools(F.col("tools")), F.array().cast("array<string>")))
    names = F.array_join(F.transform("t", lambda x: F.get_json_object(x, "$.function.name")), ",")
    return df.select("id", names.alias("names"), F.size("t").cast("long").alias("n"))


@query("""select id, cast(case when tools is null then 0 when json_valid(tools) and json_type(tools) = 'ARRAY' then json_array_length(tools) else 1 end as bigint) as n from tool_cells""")
def b9_tools_list(spark, sf_dir):
    return fixture(spark, sf_dir, "tool_cells").select("id", F.size(ss.tool_list(F.col("tools"))).cast("long").alias("n"))


@query("""select id, case when tools is null then '' when json_valid(tools) and json_type(tools) = 'ARRAY' then coalesce(array_to_string(list_transform(json_extract(tools, '$[*]'), lambda x: '" ' || """ + _dumped("x::varchar") + """ || ' "'), chr(10) || chr(10)), '')
  else '" ' || tools || ' "' end as prompt from tool_cells""")
def b10_tools_text(spark, sf_dir):
    return fixture(spark, sf_dir, "tool_cells").select("id", ss.tool_prompt(ss.tool_texts(F.col("tools"))).alias("prompt"))


@query("""select conv_id, 'checklist' as name, count(*) as n_full, coalesce(min(turn) filter (where role = 'user') + 1, 0) as n_prompt, true as need_tools_kwargs, cast(conv_id as varchar) as original_index
from conversations group by conv_id""")
def b11_pack_nested(spark, sf_dir):
    arrays = turns.as_arrays(_conversations(spark, sf_dir))
    extra = F.struct(
        F.col("messages"),
        F.struct(F.lit("checklist").alias("name"), F.array().cast("array<string>").alias("checklist_list")).alias("interaction_kwargs"),
        F.lit(True).alias("need_tools_kwargs"),
        F.col("conv_id").cast("string").alias("original_index"),
    )
    packed = arrays.select("conv_id", extra.alias("extra_info"), turns.through_first_user(F.col("messages")).alias("prompt"))
    return packed.select(
        "conv_id",
        F.col("extra_info.interaction_kwargs.name").alias("name"),
        F.size("extra_info.messages").cast("long").alias("n_full"),
        F.size("prompt").cast("long").alias("n_prompt"),
        F.col("extra_info.need_tools_kwargs").alias("need_tools_kwargs"),
        F.col("extra_info.original_index").alias("original_index"),
    )


@query("""select id, case cast(id % 5 as int) when 0 then '{"keep":' || cast(id as varchar) || '}' when 1 then '{}' when 2 then '{}' when 3 then 'broken' else '{"keep":1,"tools":[{"name":"t"}]}' end as value from extra_cells""")
def b13_drop_keys(spark, sf_dir):
    return fixture(spark, sf_dir, "extra_cells").select("id", ss.without_keys(F.col("extra")).alias("value"))


@query("select row_id, turn_idx::bigint as turn_idx, gt_action, false as has_tools from mixed_annotations")
def b14_shrink(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations")
    wide = notes.select("row_id", F.array(F.struct(F.col("turn_idx").cast("long").alias("turn_idx"), "gt_action", F.lit("[]").alias("tools"))).alias("a"))
    slim = wide.select("row_id", F.explode(F.transform("a", lambda x: x.dropFields("tools"))).alias("x")).select("row_id", "x.*")
    return slim.withColumn("has_tools", F.lit("tools" in slim.columns))


@query("""select id, case when tools = '[{"name":"own"}]' then 'own' when id % 5 = 4 then 't' else '' end as name from extra_cells""")
def b15_tools_coalesce(spark, sf_dir):
    both = ss.coalesce_tools(F.col("tools"), F.get_json_object("extra", "$.tools"))
    return fixture(spark, sf_dir, "extra_cells").select("id", F.array_join(ss.tool_names(F.coalesce(both, F.lit("[]"))), ",").alias("name"))


@query("""select id, case when id % 5 = 4 then 'extra' when id % 3 = 1 then 'plain' else 'prompt' end as origin from extra_cells""")
def b16_messages_coalesce(spark, sf_dir):
    df = fixture(spark, sf_dir, "extra_cells")
    got = ss.coalesce_messages(F.get_json_object("extra", "$.tools"), F.lit(None).cast("string"), F.col("tools"), F.lit('["p"]'))
    origin = F.when(got == F.get_json_object("extra", "$.tools"), "extra").when(got == F.col("tools"), "plain").otherwise("prompt")
    return df.select("id", origin.alias("origin"))


@query("select id, cast(id % 3 as bigint) as n from tool_cells")
def b17_checklists(spark, sf_dir):
    listed = F.concat(F.lit('{"interaction_kwargs":{"checklist_list":['), F.array_join(F.slice(F.array(F.lit('"a"'), F.lit('"b"')), 1, (F.col("id") % 3).cast("int")), ","), F.lit("]}}"))
    return fixture(spark, sf_dir, "tool_cells").select("id", F.size(ss.checklists(listed)).cast("long").alias("n"))


@query("select row_id, count(*) as n, true as use_uq_reward from mixed_annotations group by row_id")
def b18_enable_uq(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations").groupBy("row_id").agg(F.collect_list(F.struct("turn_idx", "gt_action")).alias("a"))
    flagged = notes.withColumn("a", F.transform("a", lambda x: x.withField("use_uq_reward", F.lit(True))))
    return flagged.select("row_id", F.size("a").cast("long").alias("n"), F.exists("a", lambda x: x["use_uq_reward"]).alias("use_uq_reward"))


@query("""select row_id, turn_idx::bigint as turn_idx, gt_action, case gt_action when 'A' then 'direct_answer' when 'B' then 'tool_call' when 'C' then 'request_for_info' else 'cannot_answer' end as gt_action_name,
  'answer ' || cast(row_id as varchar) as answer, 'cm2:' || cast(row_id as varchar) || ':turn:' || cast(turn_idx as varchar) as rollout_key, true as use_uq_reward from mixed_annotations""")
def b19_enrich(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations").withColumn("turn_idx", F.col("turn_idx").cast("long"))
    notes = notes.withColumn("chosen_response", F.lit("")).withColumn("target_answer", F.concat(F.lit("answer "), F.col("row_id").cast("string")))
    return annotate.enriched(notes)


@query("""with m as (select row_id, turn_idx, gt_action, row_id % 3 as k, '{"name": "f' || (row_id % 7) || '", "arguments": {"x": ' || row_id || '}}' as call from mixed_annotations),
n as (select *, case k when 0 then 'X' else gt_action end as g from m)
select row_id, cast(turn_idx as bigint) as turn_idx, g as gt_action, case g when 'A' then 'direct_answer' when 'B' then 'tool_call' when 'C' then 'request_for_info' when 'D' then 'cannot_answer' end as gt_action_name,
  case when g = 'X' then call when g = 'B' then '<tool_call>' || chr(10) || '{"arguments": {"x": ' || row_id || '}, "name": "f' || (row_id % 7) || '"}' || chr(10) || '</tool_call>' else call end as chosen_response,
  case when g <> 'X' then 'f' || (row_id % 7) end as called_tool_name, case when g <> 'X' then 'cm2:' || row_id || ':turn:' || turn_idx end as rollout_key, case when g <> 'X' then true end as use_uq_reward from n""")
def b19_tool_answers(spark, sf_dir):
    """Annotations whose answers are calls: labelled ones enriched, the others passed through."""
    notes = fixture(spark, sf_dir, "mixed_annotations").withColumn("turn_idx", F.col("turn_idx").cast("long"))
    call = F.concat(F.lit('{"name": "f'), F.col("row_id") % 7, F.lit('", "arguments": {"x": '), "row_id", F.lit("}}"))
    notes = notes.withColumn("chosen_response", call).withColumn("gt_action", F.when(F.col("row_id") % 3 == 0, "X").otherwise(F.col("gt_action")))
    return annotate.enriched_rows(notes).drop("target_answer")


_STEPS = """'{{"id":' || event_id || ',"steps":[{{"args":{},"depends_on":' || {} || ',"sub":{{"deep":{{"depends_on":' || {} || ',"x":{}}}}}}}]}}'"""


@query("select event_id, " + _STEPS.format("null", """case event_id % 4 when 0 then '[]' when 1 then '["s1"]' when 2 then '["s1",null]' else '[{"depends_on":null}]' end""", "'[' || replace(props, ' ', '') || ']'", "null") + " as cell from events")
def b6_nested_cells(spark, sf_dir):
    """Steps that depend on others, five levels deep: lists for what they depend on, null for empty objects."""
    depends = """case event_id % 4 when 0 then 'null' when 1 then '"s1"' when 2 then '["s1",{}]' else '{"depends_on":null}' end"""
    cells = fixture(spark, sf_dir, "events").select("event_id", F.expr(_STEPS.format("{}", depends, "props", "{}")).alias("cell"))
    return nested.rewritten(cells, "cell", nested.depends_as_list, nested.empty_as_null)


@query("""select event_id, '{"by":{"' || user_id || '":[{"at":"' || strftime(ts, '%Y-%m-%d') || '","none":null,"type":"' || event_type || '","value":' || coalesce(cast(case when event_id % 5 <> 0 then event_id + 0.5e0 end as varchar), 'null') || '}]}}' as cell from events""")
def b4_nested_values(spark, sf_dir):
    """Maps with number keys, dates and numbers that are not finite, in a list in a map in a record."""
    inner = F.struct(F.to_date("ts").alias("at"), F.lit(None).cast("binary").alias("none"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("event_id") + 0.5).alias("value"))
    df = fixture(spark, sf_dir, "events").select("event_id", F.struct(F.create_map("user_id", F.array(inner)).alias("by")).alias("record"))
    return df.select("event_id", nested.json_text(df, "record").alias("cell"))


@query("select id, coalesce(lower(trim(flag)) in ('1', 'true', 'yes', 'on'), false) as flag from extra_cells")
def b20_bool(spark, sf_dir):
    return fixture(spark, sf_dir, "extra_cells").select("id", classify.truthy(F.col("flag")).alias("flag"))


@query("select conv_id, turn, coalesce(role, '') as role, trim(coalesce(text, '')) as content from conversations")
def b21_accessors(spark, sf_dir):
    text = F.coalesce("content", F.lit(""))
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), tx.strip(text).alias("content"))


@query("select doc_id, doc_id as idx, lang as style from documents")
def b22_row_index(spark, sf_dir):
    cell = F.to_json(F.struct(F.col("lang").alias("style")))
    df = fixture(spark, sf_dir, "documents").select("doc_id", cell.alias("reward_model"))
    return df.select("doc_id", F.col("doc_id").alias("idx"), F.get_json_object("reward_model", "$.style").alias("style"))


@query("select doc_id, 'checklist' as data_source from documents")
def b23_default_source(spark, sf_dir):
    return io.with_default_source(fixture(spark, sf_dir, "documents").select("doc_id"), "checklist")


# Sources and sinks.


@query("select doc_id, lang, source, n_chars from documents")
def a1_parquet_scan(spark, sf_dir):
    return io.read_rows(spark, f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, props as raw from events")
def a2_json_columns(spark, sf_dir):
    df = io.parse_json_columns(fixture(spark, sf_dir, "events").select("event_id", F.col("props").alias("extra_info"), "props"))
    return df.select("event_id", F.variant_get("extra_info", "$.k", "bigint").alias("k"), F.coalesce("extra_info_raw", "props").alias("raw"))


@query("select event_id as idx, json_valid(cell) as ok from json_cells where cell <> ''")
def a3_jsonl_skip_bad(spark, sf_dir):
    cells = fixture(spark, sf_dir, "json_cells").withColumnRenamed("event_id", "idx")
    return io.parse_lines(cells).select("idx", "ok")


def _scratch(spark, name: str) -> str:
    """A fresh folder below the folder that all executors see."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="turnwright-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("select n_nationkey as id, n_name as name from nation")
def a4_json_array(spark, sf_dir):
    nation = fixture(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    path = _scratch(spark, "json-array")
    listed = nation.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("value"))  # 25 rows
    listed.coalesce(1).write.text(path)
    items = io.read_json_array(spark, path)
    kind = dict(fixture(spark, sf_dir, "nation").dtypes)["n_nationkey"]
    return items.select(F.get_json_object("item", "$.id").cast(kind).alias("id"), F.get_json_object("item", "$.name").alias("name"))


@query("select r_regionkey as id, r_name as name from region")
def a5_json_data_array(spark, sf_dir):
    region = fixture(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    path = _scratch(spark, "json-data")
    listed = region.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("data"))).alias("value"))  # 5 rows
    listed.coalesce(1).write.text(path)
    kind = dict(region.dtypes)["id"]
    return io.read_json_array(spark, path).select(F.get_json_object("item", "$.id").cast(kind).alias("id"), F.get_json_object("item", "$.name").alias("name"))


@query("select conv_id, count(*) as n, string_agg(role, ',' order by turn) as roles from conversations group by conv_id")
def a8_json_sink_roundtrip(spark, sf_dir):
    path = _scratch(spark, "json-stable")
    io.write_rows(turns.as_arrays(_conversations(spark, sf_dir)), path)
    back = io.read_rows(spark, path)
    listed = F.from_json("messages", "array<struct<role:string,content:string>>")
    return back.select("conv_id", F.size(listed).cast("long").alias("n"), F.array_join(F.transform(listed, lambda m: m["role"]), ",").alias("roles"))


@query("select row_id, case when row_number() over (order by row_id) <= 64 then 'val' else 'train' end as split from mixed_rows")
def a10_head_split(spark, sf_dir):
    return sampling.head_split(fixture(spark, sf_dir, "mixed_rows"), 64).select("row_id", "split")


@query("select row_id, gt_action from mixed_annotations where turn_idx = 0")
def a11_resume_log(spark, sf_dir):
    path = _scratch(spark, "log")
    notes = fixture(spark, sf_dir, "mixed_annotations").where("turn_idx = 0")
    log = notes.select(F.col("row_id").alias("idx"), F.array(F.struct("turn_idx", "gt_action")).alias("when2call_annotations"))
    io.append_log(log, path)
    back = spark.read.schema("idx long, when2call_annotations array<struct<turn_idx:int,gt_action:string>>").json(path)
    return back.select(F.col("idx").alias("row_id"), F.col("when2call_annotations")[0]["gt_action"].alias("gt_action"))


@query("select n_nationkey as id, n_name as name from nation")
def a9_json_array_sink(spark, sf_dir):
    """The pretty-printed list of a small table, read back."""
    nation = fixture(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    kind = dict(nation.dtypes)["id"]
    whole = spark.createDataFrame([("".join(io.json_array(nation)),)], "value string")
    return whole.select(F.explode(F.from_json("value", f"array<struct<id:{kind},name:string>>")).alias("x")).select("x.*")


@query("""select 'base' as name, 'x' as value union all select 'lr', '0.2' union all select 'size', '8' union all select 'path', '/data/rows_forverl.parquet' union all select 'train', '/data/rows_train.parquet'""")
def a7_config_and_paths(spark, sf_dir):
    """A configuration merged over its base, and output paths by suffix: driver-side settings as rows."""
    whole = io.merged({"base": "x", "optim": {"lr": 0.1, "size": 8}}, {"optim": {"lr": 0.2}})
    rows = [("base", whole["base"]), ("lr", str(whole["optim"]["lr"])), ("size", str(whole["optim"]["size"]))]
    rows += [("path", io.suffixed_path("/data/rows.parquet")), ("train", io.split_path("/data/rows.parquet", "train"))]
    return spark.createDataFrame(rows, "name string, value string")


@query("""select original_index, min(row_id) as row_id from mixed_rows group by original_index""")
def a12_checklist_export(spark, sf_dir):
    rows = fixture(spark, sf_dir, "mixed_rows").select("original_index", "row_id")
    checked = rows.withColumn("row_id", F.coalesce("row_id", F.raise_error(F.lit("a row without id")).cast("long")))
    return merge.first_of_key(checked, "original_index", "row_id")


# Merges and sets.


@query("select row_id, case when row_id % 2 = 0 then 'A' end as gt_action from mixed_rows")
def f1_resume_merge(spark, sf_dir):
    rows = fixture(spark, sf_dir, "mixed_rows").select("row_id")
    old = rows.withColumn("gt_action", F.when(F.col("row_id") % 2 == 0, "A"))
    return merge.resume(rows, old)


@query("""select r.row_id, a.g as gt_action from mixed_rows r left join (select row_id, max_by(gt_action, turn_idx) as g from mixed_annotations group by row_id) a on r.row_id = a.row_id""")
def f2_log_merge(spark, sf_dir):
    log = fixture(spark, sf_dir, "mixed_annotations").withColumnRenamed("turn_idx", "line_no")
    return merge.log_merge(fixture(spark, sf_dir, "mixed_rows").select("row_id"), log)


@query("select row_id, data_source, null::varchar as gt_action from mixed_rows union all select row_id, null, gt_action from mixed_annotations")
def f3_union(spark, sf_dir):
    rows, notes = fixture(spark, sf_dir, "mixed_rows"), fixture(spark, sf_dir, "mixed_annotations")
    return merge.union(rows.select("row_id", "data_source"), notes.select("row_id", "gt_action"))


@query("select id, 'm' || cast(id as varchar) as messages from tool_cells where id % 6 in (0, 1, 2)")
def e8_required_fields(spark, sf_dir):
    rows = fixture(spark, sf_dir, "tool_cells").withColumn("messages", F.concat(F.lit("m"), F.col("id").cast("string")))
    return merge.with_required(rows, F.size(ss.tool_items(F.col("tools"))) > 0, "id", "messages").select("id", "messages")


@query("select row_id from mixed_rows where row_id not in (select row_id from mixed_annotations)")
def f4_anti(spark, sf_dir):
    return merge.without(fixture(spark, sf_dir, "mixed_rows"), fixture(spark, sf_dir, "mixed_annotations")).select("row_id")


@query("select original_index, row_id, data_source from mixed_rows qualify row_number() over (partition by original_index order by row_id) = 1")
def f5_first_wins(spark, sf_dir):
    return merge.first_of_key(fixture(spark, sf_dir, "mixed_rows").select("original_index", "row_id", "data_source"), "original_index", "row_id")


@query("""select row_id, turn_idx::bigint as turn_idx, gt_action, min(o) as origin from (
  select row_id, turn_idx, gt_action, 0 as o from mixed_annotations where row_id % 2 = 0 union all select row_id, turn_idx, gt_action, 1 from mixed_annotations) group by all""")
def f6_annotation_dedup(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations").select("row_id", F.col("turn_idx").cast("long").alias("turn_idx"), "gt_action", F.lit("").alias("target_answer"), F.lit(0).alias("place"))
    return merge.annotations_union(notes.where("row_id % 2 = 0"), notes).select("row_id", "turn_idx", "gt_action", "origin")


@query("select distinct 'tool_' || cast(conv_id % 4 as varchar) as tool_name from conversations where role = 'assistant' and (conv_id * 7 + turn) % 5 = 1")
def f7_distinct_tools(spark, sf_dir):
    calls = fixture(spark, sf_dir, "messages_marked").where("role = 'assistant'").select(F.explode(tx.tool_calls(F.col("content"))).alias("c"))
    return merge.distinct_tools(calls.select(F.col("c.name").alias("tool_name")))


@query("select id, id % 6 in (1, 2) as known from tool_cells")
def f8_membership(spark, sf_dir):
    names = ss.flat_tool_names(ss.tool_items(F.col("tools")))
    hit = F.array_contains(names, "look_up") | F.array_contains(names, "single")
    return fixture(spark, sf_dir, "tool_cells").select("id", hit.alias("known"))


# Samples.


@query("select data_source, count(*) as n from mixed_rows group by all")
def g1_source_counts(spark, sf_dir):
    return sampling.source_counts(fixture(spark, sf_dir, "mixed_rows"))


@query("select l.gt_action, count(a.row_id) as n from (select unnest(['A', 'B', 'C', 'D']) as gt_action) l left join mixed_annotations a using (gt_action) group by all")
def g2_label_counts(spark, sf_dir):
    return sampling.label_counts(fixture(spark, sf_dir, "mixed_annotations"))


_BUCKET = "n as (select gt_action, count(*) as n from mixed_annotations group by all), k as (select row_id, min({'n': n, 'g': gt_action}).g as bucket from mixed_annotations join n using (gt_action) group by all)"


@query(f"with {_BUCKET} select row_id, bucket from k")
def g3_rarest_bucket(spark, sf_dir):
    return sampling.rarest_bucket(fixture(spark, sf_dir, "mixed_annotations"))


def _md5(seed: str) -> str:
    return f"md5({seed} || ':' || cast(row_id as varchar))"


@query(f"""with {_BUCKET}, s as (select bucket, count(*) as n from k group by all), m as (select r.row_id, bucket, row_number() over (partition by bucket order by
  {_md5("cast(42 + case bucket when 'B' then 1 else 0 end as varchar)")}, r.row_id) as rk from (select row_id from mixed_rows) r left join k using (row_id))
select row_id, bucket from m where bucket is null or bucket not in ('A', 'B') or rk <= (select min(n) from s)""")
def g4_balance(spark, sf_dir):
    rows, notes = fixture(spark, sf_dir, "mixed_rows").select("row_id"), fixture(spark, sf_dir, "mixed_annotations")
    return sampling.balanced(rows, notes).select("row_id", "bucket")


@query(f"""with c as (select data_source, count(*) as n from mixed_rows group by all),
a as (select data_source, n, case when starts_with(data_source, 'cm2') or data_source = 'nvidia_nemotron_checklist' then 'cm2' else 'when2call' end as alias from c),
s as (select alias, sum(n)::bigint as size, case alias when 'cm2' then 3e0 else 1e0 end as ratio from a group by all),
g as (select alias, size, least(size, greatest(1, floor((select min(size / ratio) from s) * ratio)::bigint)) as goal from s),
q as (select data_source, n, alias, goal, size, row_number() over (partition by alias order by n desc, data_source) as i, count(*) over (partition by alias) as k, least(n, goal * n // size) as share from a join g using (alias)),
t as (select data_source, case when i < k then share else least(n, goal - coalesce(sum(share) over (partition by alias order by i rows between unbounded preceding and 1 preceding), 0)) end as target from q)
select row_id, data_source from (select row_id, data_source, row_number() over (partition by data_source order by {_md5("'42'")}, row_id) as rk from mixed_rows) r join t using (data_source) where rk <= target""")
def g5_ratio(spark, sf_dir):
    return sampling.by_ratio(fixture(spark, sf_dir, "mixed_rows"), "cm2=3,when2call=1").select("row_id", "data_source")


_ALLOC = """c as (select data_source, count(*) as n from mixed_rows group by all),
r as (select data_source, n, n * least(64, sum(n) over ()) / sum(n) over () as raw from c),
x as (select *, row_number() over (order by raw - floor(raw) desc, data_source desc) as i, 64 - sum(floor(raw)) over () as rest from r),
v as (select data_source, n, cast(floor(raw) + case when i <= rest and floor(raw) < n then 1 else 0 end as bigint) as n_val from x)"""


@query(f"with {_ALLOC} select data_source, n, n_val from v")
def g6_allocation(spark, sf_dir):
    return sampling.allocation(sampling.source_counts(fixture(spark, sf_dir, "mixed_rows")), 64)


@query(f"""with {_ALLOC} select row_id, m.data_source, case when row_number() over (partition by m.data_source order by {_md5("'42'")}, row_id) <= n_val then 'val' else 'train' end as split
from mixed_rows m join v on m.data_source = v.data_source""")
def g7_split(spark, sf_dir):
    return sampling.train_val(fixture(spark, sf_dir, "mixed_rows")).select("row_id", "data_source", "split")


@query(f"select row_id, {_md5("'42'")} as key from mixed_rows")
def g8_shuffle(spark, sf_dir):
    return sampling.shuffled(fixture(spark, sf_dir, "mixed_rows")).select("row_id", sampling.shuffle_key(42).alias("key"))


@query("""with n as (select gt_action, count(*) as n from mixed_annotations group by all)
select row_id, (m).t::bigint as turn_idx, (m).g as gt_action from (select row_id, min({'n': n, 't': turn_idx, 'g': gt_action}) as m from mixed_annotations join n using (gt_action) group by all)""")
def g9_greedy_topk1(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations").select("row_id", F.col("turn_idx").cast("long").alias("turn_idx"), "gt_action", F.lit("low").alias("uq_target_type"))
    return annotate.balanced_one(notes, sampling.label_counts(notes))


@query("select distinct row_id, turn_idx::bigint as turn_idx, gt_action from mixed_annotations")
def g10_greedy_topk2(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations").select("row_id", F.col("turn_idx").cast("long").alias("turn_idx"), "gt_action", F.lit("low").alias("uq_target_type"))
    counts = {r["gt_action"]: r["n"] for r in sampling.label_counts(notes).collect()}
    return annotate.balanced_some(notes, counts, 2)


_BATCH = "case when row_id < 60 then 0 when row_id < 200 then 1 else 2 end"


def _running() -> str:
    """Three batches, each with the counts after the ones before."""
    steps = ["l as (select unnest(['A', 'B', 'C', 'D']) as gt_action)", "n0 as (select gt_action, 0::bigint as n from l)"]
    for i in range(3):
        steps.append(f"p{i} as (select row_id, min({{'n': n, 't': turn_idx, 'g': gt_action}}) as m from mixed_annotations join n{i} using (gt_action) where {_BATCH} = {i} group by row_id)")
        steps.append(f"n{i + 1} as (select n{i}.gt_action, any_value(n) + count(p{i}.row_id) as n from n{i} left join p{i} on (m).g = n{i}.gt_action group by all)")
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select row_id, (m).t::bigint as turn_idx, (m).g as gt_action from p{i}" for i in range(3))


@query(_running())
def g10_running_counts(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations").select("row_id", "turn_idx", "gt_action", F.lit("low").alias("uq_target_type"))
    return annotate.balanced_running(notes, F.expr(_BATCH), _scratch(spark, "running"), most=1)


_GROUP = """g as (select group_key, avg(seq_ppl) filter (where pred_letter = gt_letter) as mc, avg(seq_ppl) filter (where pred_letter <> gt_letter and pred_letter <> '') as mw, count(*) as n from rollouts group by all)"""
_FILL = f"""{_GROUP}, f as (select r.*, coalesce(case when pred_letter = gt_letter then seq_ppl end, mc, 1e0) as pg, coalesce(case when pred_letter <> gt_letter and pred_letter <> '' then seq_ppl end, mw, 1e0) as pn,
  case when n >= 8 then 'group_rollout:complete' else 'group_rollout:partial' end as margin_source from rollouts r join g using (group_key))"""


@query(f"with {_GROUP} select group_key, round(mc, 12) as mean_correct, round(mw, 12) as mean_wrong, n from g")
def g11_group_means(spark, sf_dir):
    m = margins.group_means(fixture(spark, sf_dir, "rollouts"))
    return m.select("group_key", F.round("mean_correct", 12).alias("mean_correct"), F.round("mean_wrong", 12).alias("mean_wrong"), "n")


@query(f"with {_FILL} select event_id, round(pg, 12) as ppl_gt, round(pn, 12) as ppl_neg, margin_source from f")
def g12_group_margin(spark, sf_dir):
    m = margins.filled(fixture(spark, sf_dir, "rollouts"))
    return m.select("event_id", F.round("ppl_gt", 12).alias("ppl_gt"), F.round("ppl_neg", 12).alias("ppl_neg"), "margin_source")


@query("select user_id, event_id % 5 as turn, round(avg(seq_ppl), 12) as score, count(seq_ppl) as n from rollouts group by all")
def g13_turn_mean(spark, sf_dir):
    df = fixture(spark, sf_dir, "rollouts").select("user_id", (F.col("event_id") % 5).alias("turn"), F.col("seq_ppl").alias("value"))
    return margins.turn_means(df, ["user_id"]).withColumn("score", F.round("score", 12))


@query("with c as (select gt_action, count(*) as n from mixed_annotations group by all) select gt_action, n, n = min(n) over () as under, n = max(n) over () as over from c")
def g14_extreme_labels(spark, sf_dir):
    return annotate.extreme_labels(sampling.label_counts(fixture(spark, sf_dir, "mixed_annotations")))


@query("select row_id, string_agg(cast(turn_idx as varchar) || gt_action, ',' order by turn_idx, gt_action) as ordered from mixed_annotations group by row_id")
def g15_annotation_sort(spark, sf_dir):
    notes = fixture(spark, sf_dir, "mixed_annotations").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "gt_action"))).alias("a"))
    return notes.select("row_id", F.array_join(F.transform("a", lambda x: F.concat(x["turn_idx"].cast("string"), x["gt_action"])), ",").alias("ordered"))


@query("select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by user_id")
def g16_latest_by_key(spark, sf_dir):
    return merge.latest_by_key(fixture(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("select row_id from mixed_rows order by row_id limit 64")
def g17_limit(spark, sf_dir):
    return fixture(spark, sf_dir, "mixed_rows").select("row_id").orderBy("row_id").limit(64)


@query("select count(*) as total, count(*) filter (where row_id in (select row_id from mixed_annotations)) as labeled, count(*) filter (where row_id not in (select row_id from mixed_annotations)) as skipped from mixed_rows")
def g18_counters(spark, sf_dir):
    noted = fixture(spark, sf_dir, "mixed_annotations").select("row_id").distinct().withColumn("has", F.lit(True))
    rows = fixture(spark, sf_dir, "mixed_rows").select("row_id").join(noted, "row_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("has")).alias("labeled"), F.count_if(F.col("has").isNull()).alias("skipped"))


# Uncertainty.

_LP = "list_transform(embedding, lambda x: -abs(cast(x as double)))"


def _logprobs(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"))


@query(f"select vec_id, round(exp(-list_sum({_LP}) / len(embedding)), 6) as value from embeddings")
def h1_ppl(spark, sf_dir):
    return _logprobs(spark, sf_dir).select("vec_id", F.round(uq.perplexity(F.col("lp")), 6).alias("value"))


_SOFT = f"w as (select vec_id, list_transform({_LP}[1:4], lambda x: exp(x - list_max({_LP}[1:4]))) as w from embeddings)"


@query(f"with {_SOFT} select vec_id, round(exp(-list_sum(list_transform(w, lambda x: x / list_sum(w) * ln(x / list_sum(w))))), 6) as value from w")
def h2_option_ppl(spark, sf_dir):
    return _logprobs(spark, sf_dir).select("vec_id", F.round(uq.option_perplexity(F.slice("lp", 1, 4)), 6).alias("value"))


@query(f"select vec_id, round(case when p <= 1 then 0 else least(1e0, (p - 1) / 3e0) end, 6) as value from (select vec_id, exp(-list_sum({_LP}) / len(embedding)) as p from embeddings)")
def h3_uq(spark, sf_dir):
    return _logprobs(spark, sf_dir).select("vec_id", F.round(uq.normalized_perplexity(uq.perplexity(F.col("lp"))), 6).alias("value"))


@query(f"""with p as (select vec_id, least(1e0, greatest(1e-10, exp({_LP}[1]))) as p from embeddings), e as (select vec_id, exp(-(p * ln(p)) - case when p < 1 then (1 - p) * ln((1 - p) / 3e0) else 0 end) as x from p)
select vec_id, round(case when x <= 1 then 0 else least(1e0, (x - 1) / 3e0) end, 6) as value from e""")
def h4_chosen_uq(spark, sf_dir):
    return _logprobs(spark, sf_dir).select("vec_id", F.round(uq.chosen_uncertainty(F.get("lp", F.lit(0))), 6).alias("value"))


@query(f"""with m as (select vec_id, list_filter({_LP}, lambda x, i: (i - 1) % 7 <> 0) as lp from embeddings) select vec_id, round(exp(-list_sum(lp) / len(lp)), 6) as value from m""")
def h10_masked_ppl(spark, sf_dir):
    mask = F.transform("lp", lambda x, i: (i % 7 != 0).cast("int"))
    df = _logprobs(spark, sf_dir).withColumn("mask", mask)
    return df.select("vec_id", F.round(uq.perplexity(uq.unmasked(F.col("lp"), F.col("mask"))), 6).alias("value"))


@query(f"""with m as (select vec_id, list_filter({_LP}, lambda x, i: (i - 1) % 7 <> 0 and vec_id % 9 <> 0) as lp from embeddings)
select vec_id, round(coalesce(-list_sum(lp) / nullif(len(lp), 0), 0), 9) as sequence_nll, round(coalesce(exp(-list_sum(lp) / nullif(len(lp), 0)), 0), 9) as sequence_ppl, cast(len(lp) as bigint) as token_count from m""")
def h10_sequence_summary(spark, sf_dir):
    mask = F.transform("lp", lambda x, i: ((i % 7 != 0) & (F.col("vec_id") % 9 != 0)).cast("int"))
    s = _logprobs(spark, sf_dir).withColumn("s", uq.sequence_summary(F.col("lp"), mask))
    return s.select("vec_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("sequence_nll", "sequence_ppl")], "s.token_count")


@query("select event_id, round(greatest(0e0, least(1e0, value)), 6) as value, isfinite(value) as finite from events")
def h11_clamp(spark, sf_dir):
    v = F.col("value")
    return fixture(spark, sf_dir, "events").select("event_id", F.round(uq.clamp01(v.cast("string")), 6).alias("value"), uq.is_finite(v.cast("string")).alias("finite"))


_U = "(('0x' || substr(md5(rollout_key), 1, 16))::ubigint::double / 18446744073709551616e0)"
_ROUTE = f"case when {_U} < 0.25 then 'hard' when {_U} < 0.5 then 'random' else 'none' end"
_HARD = "case gt_letter when 'A' then 'B' when 'B' then 'A' when 'C' then 'A' else 'C' end"


@query(f"select event_id, round({_U}, 6) as u, {_ROUTE} as route from rollouts")
def h12_route(spark, sf_dir):
    k = F.col("rollout_key")
    return fixture(spark, sf_dir, "rollouts").select("event_id", F.round(uq.hash_share(k), 6).alias("u"), uq.route(k).alias("route"))


@query(f"select event_id, {_HARD} as neg from rollouts")
def h13_hard_negative(spark, sf_dir):
    return fixture(spark, sf_dir, "rollouts").select("event_id", uq.hard_negative(F.col("gt_letter")).alias("neg"))


@query()
def h14_random_negative(spark, sf_dir):
    return fixture(spark, sf_dir, "rollouts").select("event_id", uq.random_negative("gt_letter", "rollout_key").alias("neg"))


@query("""select event_id, case event_id % 5 when 0 then gt_letter when 1 then 'C' when 2 then 'A' when 3 then 'D' else 'A' end as letter from rollouts""")
def h15_letter_from_gt(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lower("gt_letter")).when(k == 1, "request_for_info").when(k == 2, "direct").when(k == 3, " cannot_answer ").otherwise("unknown")
    return fixture(spark, sf_dir, "rollouts").select("event_id", tx.gt_letter(raw).alias("letter"))


@query("select event_id, round(value, 4) as r4, round(value, 6) as r6 from events")
def h16_round(spark, sf_dir):
    return fixture(spark, sf_dir, "events").select("event_id", F.round("value", 4).alias("r4"), F.round("value", 6).alias("r6"))


# Rewards.

_F1 = """case when len(ta) > 0 and len(tb) > 0 then coalesce(2e0 * list_sum(list_transform(list_distinct(ta), lambda t: least(len(list_filter(ta, lambda x: x = t)), len(list_filter(tb, lambda x: x = t))))) / (len(ta) + len(tb)), 0) else 0e0 end"""
_PARSED = f"""p as (select conv_id, turn, gt_letter as gt, chosen_response as ga, {_LETTER} as letter, {_ANSWER} as pa, {_THINK} as thought, {_SOURCE} as source, {_SUGGESTED} as suggested, {_CATEGORY} as category from responses),
f as (select *, 0.5e0 * (thought is not null)::int + 0.5e0 * (pa is not null)::int + 0.3e0 * (letter is not null)::int + 0.3e0 * coalesce(length(source) >= 4, false)::int + 0.15e0 * (category is not null)::int + 0.4e0 * coalesce(suggested = letter, false)::int as r_fmt,
  case when letter is null then 0e0 when letter = gt then 2e0 when (letter in ('A', 'B')) = (gt in ('A', 'B')) then 1e0 else 0e0 end as r_cls,
  case when letter is null then 'missing' when letter = gt then 'exact' when (letter in ('A', 'B')) = (gt in ('A', 'B')) then 'direction' else 'wrong' end as cls_type,
  regexp_extract_all(lower(coalesce(pa, '')), '[A-Za-z0-9_]+') as ta, regexp_extract_all(lower(coalesce(ga, '')), '[A-Za-z0-9_]+') as tb from p),
a as (select *, case when coalesce(pa, '') = '' or coalesce(ga, '') = '' or letter is null then 0e0
  when letter = 'B' then case when contains(pa, '<tool_call>') then 0.5e0 * contains(ga, '<tool_call>')::int + 0.5e0 * case when contains(ga, '<tool_call>') then case when conv_id = conv_id % 10 then 1e0 else 0.5e0 end else 0e0 end else 0e0 end
  when letter = 'C' then case when contains(pa, '?') or {_any('lower(pa)', tx.QUESTION_CUES)} then {_F1} else 0e0 end
  when letter = 'D' then case when not (contains(pa, '?') or {_any('lower(pa)', tx.QUESTION_CUES)}) and {_any('lower(pa)', tx.REFUSAL_CUES)} then {_F1} else 0e0 end
  else {_F1} end as r_align from f),
m as (select event_id as conv_id, seq_ppl as pg, seq_ppl + (event_id % 7 - 3) / 10e0 as pn from rollouts)"""


def _with_margin(spark, sf_dir) -> DataFrame:
    r = fixture(spark, sf_dir, "rollouts").select(F.col("event_id").alias("conv_id"), F.col("seq_ppl").alias("pg"), (F.col("seq_ppl") + (F.col("event_id") % 7 - 3) / F.lit(10.0)).alias("pn"))
    return fixture(spark, sf_dir, "responses").join(r, "conv_id", "left")


@query(f"with {_PARSED} select conv_id, turn, round(r_fmt, 4) as r_fmt, coalesce(suggested, '') as suggested_action, coalesce(suggested = letter, false) as self_consistent, category is not null as category_match from a")
def h5a_format(spark, sf_dir):
    parts = reward.format_parts(F.col("response"), tx.letter(F.col("response")))
    df = fixture(spark, sf_dir, "responses")
    return df.select("conv_id", "turn", F.round(parts["r_fmt"], 4).alias("r_fmt"), *[parts[k].alias(k) for k in ("suggested_action", "self_consistent", "category_match")])


@query(f"with {_PARSED} select conv_id, turn, r_cls, cls_type from a")
def h5b_correctness(spark, sf_dir):
    score, kind = reward.correctness(F.col("l"), F.col("gt_letter"))
    df = fixture(spark, sf_dir, "responses").withColumn("l", tx.letter(F.col("response")))
    return df.select("conv_id", "turn", score.alias("r_cls"), kind.alias("cls_type"))


@query(f"with {_PARSED} select conv_id, turn, round(r_align, 4) as r_align from a")
def h5c_align(spark, sf_dir):
    scored = reward.score(fixture(spark, sf_dir, "responses"), ["conv_id", "turn"])
    return scored.select("conv_id", "turn", "r_align")


@query("""select event_id, round(1 / (1 + exp(-greatest(-30e0, least(30e0, (event_id % 13 - 6) / 2e0 / 0.1e0)))), 6) as cert from events where abs((event_id % 13 - 6) / 2e0 / 0.1e0) < 30
union all select event_id, case when event_id % 13 > 6 then 1e0 else 0e0 end from events where abs((event_id % 13 - 6) / 2e0 / 0.1e0) >= 30""")
def h5e_cert(spark, sf_dir):
    margin = (F.col("event_id") % 13 - 6) / F.lit(2.0)
    return fixture(spark, sf_dir, "events").select("event_id", F.round(uq.certainty(margin), 6).alias("cert"))


@query(f"""with {_PARSED}, z as (select a.*, pg, pn, case when pg is null or pn is null then 0e0 else pn - pg end as margin from a left join m using (conv_id)),
c as (select *, 1 / (1 + exp(-(margin / 0.1e0))) as cert, letter is not null and coalesce(pa, '') <> '' as formed from z),
s as (select *, case when formed then cert else 0e0 end as rp, greatest(0e0, least(2e0, r_align + case when formed then cert else 0e0 end)) as r_ans from c)
select conv_id, turn, round((r_fmt + r_ans + cert * r_cls) / 6.15e0, 4) as score, 1::bigint as num_turns, 1::bigint as max_num_turns, true as tool_call_success,
  round(r_fmt + r_ans + cert * r_cls, 4) as raw_score, 6.15e0 as max_score, round(r_fmt, 4) as r_fmt, round(r_ans, 4) as r_ans, round(r_align, 4) as r_align, round(rp, 4) as r_ppl_action, r_cls, round(cert, 4) as cert,
  0.1e0 as tau, 1e0 as lambda, round(coalesce(pg, 0), 6) as ppl_gt, pg is not null as ppl_gt_ok, round(coalesce(pn, 0), 6) as ppl_neg, pg is not null as ppl_neg_ok, round(margin, 6) as margin, '' as neg_type, '' as drop_components, cls_type,
  coalesce(letter, '') as letter, case letter when 'A' then 'direct_answer' when 'B' then 'tool_call' when 'C' then 'request_for_info' when 'D' then 'cannot_answer' else '' end as pred_action,
  coalesce(suggested, '') as suggested_action, coalesce(suggested = letter, false) as self_consistent, category is not null as category_match, coalesce(category, '') as suggested_category, coalesce(category, '') as answer_category,
  substr(coalesce(source, ''), 1, 200) as source, 0e0 as uq_value, 'default' as uq_source from s""")
def h5_compute_score(spark, sf_dir):
    return reward.score(_with_margin(spark, sf_dir), ["conv_id", "turn"], ppl_gt="pg", ppl_neg="pn")


@query(f"with {_PARSED} select conv_id, turn, round(r_cls, 4) as r_cls, 'r_ans,r_fmt' as drop_components, round(0.5e0 * r_cls / 6.15e0, 4) as score from a")
def h5f_drop(spark, sf_dir):
    config = reward.RewardConfig(drop=("r_fmt", "r_ans"))
    return reward.score(fixture(spark, sf_dir, "responses"), ["conv_id", "turn"], config=config).select("conv_id", "turn", "r_cls", "drop_components", "score")


@query("""with e as (select conv_id, turn, role, text from conversations), r as (
  select conv_id as row_id, turn as position, 0.5e0 as reward from e where role = 'assistant' union all select conv_id, max(turn), 1e0 from e group by conv_id)
select row_id, position, round(sum(reward), 6) as reward from r group by all""")
def h6_sparse_combine(spark, sf_dir):
    msgs = _conversations(spark, sf_dir)
    each = msgs.where("role = 'assistant'").select(F.col("conv_id").alias("row_id"), F.col("turn").alias("position"), F.lit(0.5).alias("reward"))
    last = msgs.groupBy(F.col("conv_id").alias("row_id")).agg(F.max("turn").alias("position")).withColumn("reward", F.lit(1.0))
    return reward.sparse_sum(each, last).withColumn("reward", F.round("reward", 6))


def _batch(spark, sf_dir) -> tuple[DataFrame, ...]:
    """A mixed batch: every second conversation is a trajectory of scored turns, the others' responses are single actions."""
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id")
    source = F.when(F.col("conv_id") % 2 == 0, "cm2_main").otherwise("when2call").alias("data_source")
    said = fixture(spark, sf_dir, "responses")
    mask = F.transform(F.sequence(F.lit(0), F.col("turn") + 9), lambda i: (i < F.col("turn") + F.col("conv_id") % 7).cast("int"))
    rows = said.select(key, source, mask.alias("attention_mask"), F.col("turn").cast("int").alias("prompt_length"))
    scored = reward.score(said, ["conv_id", "turn"])
    actions = scored.select(key, "score", "r_fmt", "letter")
    # Two annotations on the first turn, one on the second of some rows; the numbers are the scorer's.
    notes = scored.select(key, "score", "letter", F.explode(F.expr("sequence(0, cast(conv_id % 3 as int))")).alias("number"))
    turn = F.greatest(F.col("number") - 1, F.lit(0))
    notes = notes.select("row_id", turn.alias("turn_idx"), (turn * 3 + 2).alias("position"), (F.col("score") / (F.col("number") + 1)).alias("score"), F.col("letter").alias("pred_label"), F.concat(F.lit("g"), "number").alias("gt_label"), "number")
    checks = said.where("conv_id % 4 <> 2").select(key, F.lit(2).alias("position"), F.lit(0.25).alias("reward"))
    return rows, checks, notes, actions


_MIXED = f"""with {_PARSED}, s as (select conv_id, turn, conv_id * 1000 + turn as row_id, conv_id % 2 = 0 as cm2, letter, round((r_fmt + least(2e0, r_align + case when letter is not null and coalesce(pa, '') <> '' then 0.5e0 else 0e0 end) + 0.5e0 * r_cls) / 6.15e0, 4) as score, r_fmt from a),
n as (select row_id, greatest(i - 1, 0) as turn_idx, score / (i + 1) as score, letter, i from (select *, unnest(range(0, conv_id % 3 + 1)) as i from s where cm2)),
t as (select row_id, turn_idx, avg(score * 0.5e0) as reward, count(*) as n, max_by(letter, i) as p, 'g' || max(i) as g from n group by all)"""


@query(f"""{_MIXED}, r as (select row_id, turn_idx * 3 + 2 as position, reward from t union all select row_id, 2, 0.25e0 from s where cm2 and conv_id % 4 <> 2
  union all select row_id, greatest(conv_id % 7 - 1, 0), score from s where not cm2)
select row_id, cast(position as int) as position, round(sum(reward), 9) as reward from r group by all""")
def h6_mixed_rewards(spark, sf_dir):
    """Checklists, weighted turns and single actions as sparse rewards of one batch."""
    return reward.mixed_rewards(*_batch(spark, sf_dir), weight=0.5)[0].withColumn("reward", F.round("reward", 9))


@query(f"""{_MIXED}, w as (select row_id, sum(n) as used, round(sum(reward), 4) as raw, string_agg(turn_idx || ':' || coalesce(p, '') || ':' || g, ',' order by turn_idx) as turns from t group by row_id)
select row_id, cast(used as bigint) as used_annotations, cast(used as bigint) as num_annotations, raw as raw_sum, turns, case when not cm2 then score end as score, case when not cm2 then round(r_fmt, 4) end as r_fmt, 1 as max_num_turns, true as tool_call_success
from s left join w using (row_id)""")
def g13_row_totals(spark, sf_dir):
    """Metrics of the same batch: totals and used annotations of trajectories, the scorer's own for single actions."""
    m = reward.mixed_rewards(*_batch(spark, sf_dir), weight=0.5)[1]
    own = lambda c: F.col(f"cm2_when2call_{c}")
    each = F.zip_with(own("turns"), F.zip_with(own("pred_labels"), own("gt_labels"), lambda p, g: F.concat(F.coalesce(p, F.lit("")), F.lit(":"), g)), lambda t, x: F.concat(t.cast("string"), F.lit(":"), x))
    names = [own(c).alias(c) for c in ("used_annotations", "num_annotations", "raw_sum")]
    return m.select("row_id", *names, F.array_join(each, ",").alias("turns"), "score", "r_fmt", "max_num_turns", "tool_call_success")


@query(r"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) as w from documents), c as (select doc_id, w, count(*) as n from t group by all), z as (select doc_id, sum(n) as n from c group by all),
i as (select a.doc_id, sum(least(a.n, b.n)) as k from c a join c b on b.doc_id = a.doc_id + 1 and a.w = b.w group by all)
select d.doc_id as pair_id, round(coalesce(2e0 * i.k / (x.n + y.n), 0), 6) as f1 from documents d join documents e on e.doc_id = d.doc_id + 1 left join i on i.doc_id = d.doc_id left join z x on x.doc_id = d.doc_id left join z y on y.doc_id = e.doc_id""")
def h7_token_f1(spark, sf_dir):
    docs = fixture(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), "text")
    out = reward.pairwise_token_f1(docs, docs.withColumn("pair_id", F.col("pair_id") - 1))
    return out.select("pair_id", F.round("f1", 6).alias("f1"))


_SAID = f"""{_TM}, {_FIRST},
n as (select conv_id, turn_idx, case when has then 'B' else {_E2} end as gt_letter, case when has then content else body end as chosen_response from g where has or body <> ''),
o as (select conv_id, turn_idx, coalesce(min_by(content, turn) filter (where contains(content, '<tool_call>')), max_by(content, turn)) as said, bool_or(contains(content, '<tool_call>')) as tool from t where role = 'assistant' group by all),
z as (select conv_id, turn_idx, max(turn) as position from t group by all),
q as (select conv_id, turn_idx as turn, position, gt_letter, chosen_response, case when tool then '<think>source=structured suggested_action=tool_call <B></think>' || chr(10) || 'tool_call<B>' || chr(10) || '<answer>' || said || '</answer>' else trim(said, ' ' || chr(10)) end as response
  from o join n using (conv_id, turn_idx) join z using (conv_id, turn_idx))"""
#: A turn's call, where it has to be one, is the annotated one.
_SCORED = _PARSED[: _PARSED.index(",\nm as")].replace("from responses", "from q").replace("case when conv_id = conv_id % 10 then 1e0 else 0.5e0 end", "1e0")
_SCORED = _SCORED.replace("\nf as (", "\nff as (").replace("from f)", "from ff)")


@query(f"""with {_SAID}, {_SCORED} select a.conv_id, turn as turn_idx, position, round(round((r_fmt + least(2e0, r_align + case when formed then 0.5e0 else 0e0 end) + 0.5e0 * r_cls) / 6.15e0, 4), 4) as reward, 1 as n
from (select *, letter is not null and coalesce(pa, '') <> '' as formed from a) a join q using (conv_id, turn)""")
def h8_trajectory_reward(spark, sf_dir):
    """Each annotated turn's response in canonical form, scored against its annotation, at the turn's end."""
    turned = _marked(spark, sf_dir)
    said = turns.tool_or_last(turned)
    thought = F.when(F.col("has_tool"), F.lit("source=structured suggested_action=tool_call <B>")).otherwise(F.coalesce(tx.think_only(F.col("content")), F.lit("")))
    said = said.withColumn("p", tx.unified_parts(F.col("content")))
    action = F.when(F.col("has_tool"), F.lit("tool_call")).otherwise(F.col("p.action"))
    label = F.when(F.col("has_tool"), F.lit("B")).otherwise(F.col("p.label"))
    whole = tx.canonical(action, label, F.col("p.answer"), thought)
    outputs = said.select("conv_id", "turn_idx", F.when(action.isNotNull() & label.isNotNull(), whole).otherwise(tx.strip(F.col("content"))).alias("response"))
    notes = annotate.candidates(turned).select("conv_id", "turn_idx", F.col("gt_action").alias("gt_letter"), F.col("target_answer").alias("chosen_response"))
    scored = reward.score(outputs.join(notes, ["conv_id", "turn_idx"]), ["conv_id", "turn_idx"])
    ends = turns.end_positions(turned)
    means = margins.turn_means(scored, ["conv_id"], "turn_idx", "score").join(ends, ["conv_id", "turn_idx"])
    return means.select("conv_id", "turn_idx", F.col("end_pos").alias("position"), F.round("score", 4).alias("reward"), "n")


@query(f"""with {_PARSED} select conv_id, turn, case when conv_id % 2 = 0 then 0.5e0 else 1e0 end * round((r_fmt + least(2e0, r_align + case when letter is not null and coalesce(pa, '') <> '' then 0.5e0 else 0e0 end) + 0.5e0 * r_cls) / 6.15e0, 4) as score from a""")
def i7_registered_scorer(spark, sf_dir):
    source = F.when(F.col("conv_id") % 2 == 0, "cm2_main").otherwise("when2call")
    rows = fixture(spark, sf_dir, "responses").withColumn("data_source", source)
    return providers.scorer("mixed")(rows, ["conv_id", "turn"], weight=0.5).select("conv_id", "turn", "score")


@query(f"""with {_TM}, s as (select conv_id, turn_idx, coalesce(min_by(content, turn) filter (where contains(content, '<tool_call>')), max_by(content, turn)) as c, bool_or(contains(content, '<tool_call>')) as tool from t where role = 'assistant' group by all),
k as (select *, case when tool then 'B' when contains(lower(c), 'sorry') then 'D' when contains(c, '?') then 'C' end as label, trim(regexp_replace(c, '<think>.*?</think>', '', 'gis'), ' ' || chr(10)) as bare from s)
select conv_id, turn_idx, label, case label when 'B' then 'tool_call' when 'C' then 'request_for_info' when 'D' then 'cannot_answer' end as action, case when tool then c when label is null then bare else trim(c, ' ' || chr(10)) end as answer from k""")
def i4_turn_parse_judged(spark, sf_dir):
    said = turns.tool_or_last(_marked(spark, sf_dir))
    return reward.parse_with_judge(said, ["conv_id", "turn_idx"], "content", providers.rule_judge).drop("thought")


_PIECES, _ENDS = r"[ \n]*[^ \n]+|[ \n]+$", r"[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$"


@query(rf"""with m as (select conv_id * 1000 + turn as id, coalesce(text, '') as t from conversations),
p as (select id, unnest(w) as piece, unnest(range(1, len(w) + 1)) as i from (select id, regexp_extract_all(t, '{_PIECES}') as w from m)),
r as (select id, length(piece) as l, sum(length(piece)) over (partition by id order by i) as e from p),
q as (select id, unnest(w) as raw, unnest(range(1, len(w) + 1)) as j from (select id, regexp_extract_all(t, '{_ENDS}') as w from m)),
s as (select id, raw, j, sum(length(raw)) over (partition by id order by j) as e from q),
k as (select *, row_number() over (partition by id order by j) - 1 as sentence from s where trim(raw, ' ' || chr(9) || chr(10) || chr(13)) <> '')
select k.id, cast(sentence as int) as sentence, round(exp(avg(l / 10e0)), 9) as ppl, round(avg(l / 10e0), 9) as nll, count(*) as token_count
from k join r on r.id = k.id and r.e > k.e - length(k.raw) and r.e - r.l < k.e group by k.id, sentence""")
def h9_sentence_ppl(spark, sf_dir):
    """Pieces of words with the white space before them stand for a tokenizer's tokens."""
    msgs = _conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("content", F.lit("")).alias("text"))
    msgs = msgs.withColumn("pieces", F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0)))
    msgs = msgs.withColumn("nlls", F.transform("pieces", lambda w: F.length(w) / 10.0))
    out = providers.sentence_perplexities(msgs, "id", "text", "pieces", "nlls")
    return out.withColumn("ppl", F.round("ppl", 9)).withColumn("nll", F.round("nll", 9))


# Providers.


@query("""select conv_id, 0 as turn_idx, case when contains(l, 'sorry') then 'D' when contains(l, '?') then 'C' else 'A' end as gt_action
from (select conv_id, lower(regexp_extract(string_agg(role || ': ' || trim(text), chr(10) order by turn), '[^\n]*$')) as l from conversations group by conv_id)""")
def i1_label(spark, sf_dir):
    prompts = turns.as_arrays(_conversations(spark, sf_dir)).select("conv_id", turns.rendered_prompt(F.col("messages")).alias("prompt"))
    replies = providers.calls(prompts, "prompt", providers.rule_labeller)
    return replies.select("conv_id", F.explode(annotate.parse_reply(F.col("reply"))).alias("a")).select("conv_id", "a.turn_idx", "a.gt_action")


@query(f"""with {_FORMS} select conv_id, turn, coalesce(label, case when contains(lower(response), 'sorry') then 'D' when contains(response, '?') then 'C' end, '') as label, label is null as asked
from u join (select conv_id, turn, response from responses) using (conv_id, turn)""")
def i3_judge(spark, sf_dir):
    """Labels from the text's form, else from the object in a judge's wordy reply."""
    df = fixture(spark, sf_dir, "responses").select("conv_id", "turn", tx.unified_label(F.col("response")).alias("label"), F.col("response").alias("prompt"))
    said = providers.judged(df, "label", "prompt", providers.rule_judge)
    found = ss.object_in_text(F.concat(F.lit("I think {so}: "), "reply", F.lit(" - certain.")))
    judged = classify.valid_label(F.get_json_object(found, "$.pred_label"))
    return said.select("conv_id", "turn", F.coalesce("label", judged, F.lit("")).alias("label"), F.col("label").isNull().alias("asked"))


@query(f"select vec_id, cast(len({_LP}[-5:]) as bigint) as n, round(list_sum({_LP}[-5:]), 6) as total from embeddings")
def i5_tail_alignment(spark, sf_dir):
    tail = uq.aligned_tail(F.col("lp"), F.lit(5))
    return _logprobs(spark, sf_dir).select("vec_id", F.size(tail).cast("long").alias("n"), F.round(uq.total(tail), 6).alias("total"))


@query(f"""with {_FORMS}, w as (select conv_id, turn, regexp_extract_all(case when gt_letter = 'B' then case when has then answer else r end else {_SURFACE} end, '\\S+') as w from u)
select conv_id, turn, round(exp(list_sum(list_transform(w, lambda x: length(x) / 10e0)) / len(w)), 6) as ppl from w""")
def i6_strict_scores(spark, sf_dir):
    """Each response in the form of its true action, scored after its prompt with that action's suffix."""
    response, letter = F.col("response"), F.col("gt_letter")
    rendered = ss.rendered_tool_calls(response)
    surface = F.coalesce(*[F.when(letter == x, tx.forced_surface(response, x, rendered)) for x in tx.ACTIONS])
    prompts = turns.as_arrays(_conversations(spark, sf_dir)).select("conv_id", turns.rendered_prompt(turns.through_first_user(F.col("messages"))).alias("asked"))
    df = fixture(spark, sf_dir, "responses").join(prompts, "conv_id").withColumn("surface", surface)
    words = F.size(F.regexp_extract_all("surface", F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))
    whole = F.concat("asked", tx.prompt_suffix(letter), F.lit("\nassistant: "), "surface")
    scored = providers.calls(df.select("conv_id", "turn", whole.alias("prompt"), words.alias("n")), "prompt", providers.length_scorer)
    tail = uq.aligned_tail(F.from_json("reply", "array<double>"), F.col("n"))
    return scored.select("conv_id", "turn", F.round(uq.perplexity(tail), 6).alias("ppl"))


# Groups of rollouts, in batch and as a stream.


@query("select event_id, case when user_id % 3 = 0 then 'uid:' || cast(user_id as varchar) when user_id % 3 = 1 then 'idx:' || cast(event_id as varchar) else 'rollout:' || cast(event_id as varchar) end as key from events")
def j3_group_key(spark, sf_dir):
    k = F.col("user_id") % 3
    uid, idx = F.when(k == 0, F.col("user_id").cast("string")), F.when(k == 1, F.col("event_id"))
    key = uq.group_key(uid, idx, F.concat(F.lit("rollout:"), F.col("event_id").cast("string")))
    return fixture(spark, sf_dir, "events").select("event_id", key.alias("key"))


@query(f"""with {_FILL} select event_id, {_ROUTE} as neg_type, case when {_ROUTE} = 'hard' then {_HARD} else '' end as neg_letter, round(pg, 12) as ppl_gt, round(pn, 12) as ppl_neg, round(pn - pg, 12) as margin, margin_source from f""")
def j5_runtime_fields(spark, sf_dir):
    m = margins.runtime_fields(fixture(spark, sf_dir, "rollouts"), digits=12)
    return m.select("event_id", "neg_type", "neg_letter", "ppl_gt", "ppl_neg", "margin", "margin_source")


_STRICT = "exp((length(rollout_key) + 1) / 20e0)"


@query(f"""with f as (select *, {_ROUTE} as way, coalesce(case when pred_letter = gt_letter then seq_ppl end, case when {_ROUTE} <> 'none' then {_STRICT} end) as a,
  coalesce(case when pred_letter <> gt_letter and pred_letter <> '' then seq_ppl end, case when {_ROUTE} <> 'none' then {_STRICT} end) as b from rollouts),
g as (select group_key, avg(seq_ppl) filter (where pred_letter = gt_letter) as mc, avg(seq_ppl) filter (where pred_letter <> gt_letter and pred_letter <> '') as mw, count(*) as n
  from f where a is null or b is null group by all),
l as (select f.*, coalesce(a, mc, 1e0) as pg, coalesce(b, mw, 1e0) as pn, a is null or b is null as open, n from f left join g using (group_key))
select event_id, way as neg_type, case way when 'hard' then {_HARD} end as hard_letter, way = 'random' as random_other, 0.2e0 as tau, 0.5e0 as lambda, round(pg, 12) as ppl_gt, round(pn, 12) as ppl_neg,
  round(pn - pg, 12) as margin, case when not open then way when n >= 8 then 'group_rollout:complete' else 'group_rollout:partial' end as margin_source from l""")
def j5_ladder(spark, sf_dir):
    """Own perplexity, strict scores of routed rows by an offline scorer, group terms for the rest."""

    def strict(rows: DataFrame) -> DataFrame:
        asked = providers.calls(rows.withColumn("prompt", F.concat_ws(" ", "rollout_key", "letter")), "prompt", providers.length_scorer)
        return asked.withColumn("strict_ppl", uq.perplexity(F.from_json("reply", "array<double>")))

    out = margins.ladder(fixture(spark, sf_dir, "rollouts"), strict, _scratch(spark, "ladder"), tau=0.2, weight=0.5, digits=12)
    other = (F.col("neg_type") == "random") & F.col("neg_letter").isin(*"ABCD") & (F.col("neg_letter") != F.col("gt_letter"))
    hard = F.when(F.col("neg_type") == "hard", F.col("neg_letter")).alias("hard_letter")
    return out.select("event_id", "neg_type", hard, other.alias("random_other"), "tau", "lambda", "ppl_gt", "ppl_neg", "margin", "margin_source")


_FOURS = """d as (select *, group_key || '/' || cast(event_id % 16 as varchar) || '/' || cast((row_number() over (partition by group_key, event_id % 16 order by event_id) - 1) // 4 as varchar) as k from rollouts),
g as (select k, avg(seq_ppl) filter (where pred_letter = gt_letter) as mc, avg(seq_ppl) filter (where pred_letter <> gt_letter and pred_letter <> '') as mw, count(*) as n from d group by k)"""


@query(f"""with {_FOURS} select event_id, k as group_key, round(coalesce(case when pred_letter = gt_letter then seq_ppl end, mc, 1e0), 12) as ppl_gt,
  round(coalesce(case when pred_letter <> gt_letter and pred_letter <> '' then seq_ppl end, mw, 1e0), 12) as ppl_neg,
  case when n = 4 then 'group_rollout:complete' else 'group_rollout:timeout' end as margin_source from d join g using (k)""")
def j1_group_wait(spark, sf_dir):
    """The stream of rollouts in groups of four, or what is left over, read to its end and written to a table that is read back."""
    from turnwright.streaming.group_margin import drain, group_margins

    source, sink, marks = (_scratch(spark, f"stream-{x}") for x in ("in", "out", "marks"))
    own = Window.partitionBy("group_key", F.col("event_id") % 16).orderBy("event_id")
    four = F.floor((F.row_number().over(own) - 1) / 4)
    rollouts = fixture(spark, sf_dir, "rollouts").withColumn("four", four)
    rollouts = rollouts.withColumn("group_key", F.concat_ws("/", "group_key", F.col("event_id") % 16, "four")).drop("four")
    rollouts.write.parquet(source)
    stream = spark.readStream.schema(rollouts.schema).parquet(source)
    job = group_margins(stream, expected=4, timeout_ms=1000).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks)
    drain(job.outputMode("append").trigger(processingTime="500 milliseconds").start(), 1000)
    out = spark.read.schema("event_id long, group_key string, ppl_gt double, ppl_neg double, margin_source string").parquet(sink)
    return out.withColumn("ppl_gt", F.round("ppl_gt", 12)).withColumn("ppl_neg", F.round("ppl_neg", 12))


@query(f"with {_CAND} select conv_id, turn_idx, gt_action from h")
def j6_resume_stream(spark, sf_dir):
    """Messages in three batches, each conversation labelled once it is whole; the log is read back."""
    from turnwright.streaming.labelling import label_stream, whole_conversations

    source, sink, marks = (_scratch(spark, f"label-{x}") for x in ("in", "out", "marks"))
    msgs = fixture(spark, sf_dir, "messages_marked")
    sizes = msgs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    msgs = msgs.join(sizes, "conv_id")
    # A third of the files a batch: a file a batch would be written by one task, however large it is.
    files = len(io.write_parts(msgs, F.col("turn") % 3, source).inputFiles())
    stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).option("recursiveFileLookup", "true").parquet(source)
    label = lambda batch: annotate.candidates(turns.user_turns(batch)).select("conv_id", "turn_idx", "gt_action")
    label_stream(whole_conversations(stream), label, sink, marks, "conv_id").awaitTermination()
    return spark.read.parquet(sink).drop("batch")
