"""Queries over the fixtures, one an operator, with the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwright.functions import classify
from turnwright.functions import semistructured as ss
from turnwright.functions import text as tx
from turnwright.functions import uncertainty as uq
from turnwright.operators import prompts, annotate, merge, sampling, turns
from turnwright.plans.fixtures import fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return add


def per_response(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """A text function over the fixture of responses: conv_id, turn, value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixture(spark, sf_dir, "responses").select("conv_id", "turn", value(F.col("response")).alias("value"))

    QUERIES[name] = run
    ORACLES[name] = with_fixtures(f"select conv_id, turn, {sql} as value from responses")


# DuckDB's forms of common parts.
_ACT = "direct_answer|tool_call|request_for_info|cannot_answer"


def _x(text: str, pattern: str, group: int = 1, flags: str = "is") -> str:
    return f"case when regexp_matches({text}, '{pattern}', '{flags}') then regexp_extract({text}, '{pattern}', {group}, '{flags}') end"


_THINK = f"coalesce(trim({_x('response', '<think>(.*?)</think>')}), trim({_x('response', '[[]uq[]](.*?)[[]/uq[]]')}))"
_BLOCKS = "regexp_extract_all(response, '<tool_call>\\s*.*?\\s*</tool_call>', 0, 'is')"
_ANSWER = (
    f"case when len({_BLOCKS}) > 0 then array_to_string({_BLOCKS}, chr(10)) else "
    f"coalesce(trim({_x('response', '<answer>(.*?)</answer>')}), trim({_x('response', '[[]answer[]](.*?)[[]/answer[]]')})) end"
)
_TAG = f"({_ACT})\\s*<([ABCD])>"
_LONE = "^.*(^|[^\\p{L}\\p{N}_])([A-Da-d])($|[^\\p{L}\\p{N}_])"
_SUGGESTED = f"coalesce(upper({_x('response', _TAG, 2)}), upper({_x(f'({_THINK})', 'suggested_action\\s*=\\s*<?([ABCD])>?')}))"
_LETTER = (
    f"upper(coalesce({_x('response', _TAG, 2)}, {_x(f'({_ANSWER})', '(?m)<([ABCD])>\\s*$')}, "
    f"{_x(f'({_ANSWER})', _LONE, 2)}, {_x('response', _LONE, 2)}))"
)
_CATEGORY = f"lower({_x('response', _TAG, 1)})"
_SOURCE = (
    f"coalesce(trim({_x(f'({_THINK})', 'source\\s*=\\s*(.+?)\\s+suggested_action\\s*=')}), "
    f"trim({_x(f'({_THINK})', 'source\\s*=\\s*([^\\n]+)')}))"
)

per_response("d1_think", tx.think, _THINK)
per_response("d2_answer", tx.answer, _ANSWER)
per_response(
    "d3_internal_uq",
    lambda c: tx.uncertainty_value(c, "internal_uq"),
    f"case when regexp_matches(({_THINK}), 'internal_uq\\s*=\\s*[0-9.]', 'i') then greatest(0e0, least(1e0, cast({_x(f'({_THINK})', 'internal_uq\\s*=\\s*([0-9]*\\.?[0-9]+)')} as double))) end",
)
per_response("d4_source", tx.source, _SOURCE)
per_response("d5_suggested", tx.suggested_letter, _SUGGESTED)
per_response("d6_suggested_category", tx.category, _CATEGORY)
per_response("d7_letter", tx.letter, _LETTER)
per_response("d8_category", tx.category, _CATEGORY)
per_response(
    "d9_judge_text",
    tx.judge_text,
    "coalesce(nullif(trim(regexp_replace(" + _ANSWER + r", '(direct_answer|tool_call|request_for_info|cannot_answer)\s*<[ABCD]>\s*$', '', 'i'), ' ' || chr(10)), ''), " + _ANSWER + ", trim(response, ' ' || chr(10)))",
)
per_response(
    "d9_plain_tail",
    tx.without_blocks,
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(response, '<think>.*?</think>', '', 'gis'), "
    f"'[[]uq[]].*?[[]/uq[]]', '', 'gis'), '<answer>.*?</answer>', '', 'gis'), '[[]answer[]].*?[[]/answer[]]', '', 'gis'), '{_TAG}', '', 'gi'), "
    "' ' || chr(10))",
)
per_response(
    "d15_strip_think", tx.without_think, "trim(regexp_replace(response, '<think>.*?</think>', '', 'gis'), ' ' || chr(10))"
)
per_response(
    "d18_force_action", lambda c: tx.forced_action(c, "D"), f"regexp_replace(response, '\\b({_ACT})\\s*<\\s*([ABCD])\\s*>', 'cannot_answer<D>', 'i')"
)
per_response("d21_pred_letter", tx.tagged_letter, f"coalesce(upper({_x('response', f'\\b({_ACT})\\s*<\\s*([ABCD])\\s*>', 2)}), '')")

# The unified format in DuckDB's SQL, from a column ``r``: any form of output.
_ACT_XML, _LAB_XML = f"<action>\\s*({_ACT})\\s*</action>", "<label>\\s*([ABCD])\\s*</label>"
_GIVEN = f"suggested_action\\s*=\\s*({_ACT})\\s*<\\s*([ABCD])\\s*>"
_LOOSE = f"({_ACT})\\s*<\\s*([ABCD])\\s*>"
_R_BLOCKS = "regexp_extract_all(r, '<tool_call>\\s*(.*?)\\s*</tool_call>', 1, 'is')"


def _cut(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"


def _bare(text: str) -> str:
    for pattern in ("<think>.*?</think>", f"<action>\\s*({_ACT})\\s*</action>", _LAB_XML, _LOOSE):
        text = _cut(f"regexp_replace({_cut(text)}, '{pattern}', '', 'gis')")
    return text


def _dumped(value: str) -> str:
    """JSON text without blanks or marks inside strings, with the usual separators."""
    return f"replace(replace({value}, '\":', '\": '), ',\"', ', \"')"


#: A block's call with sorted keys; the fixtures' calls have a name and arguments without strings.
_CALL = f"'<tool_call>' || chr(10) || '{{\"arguments\": ' || {_dumped("cast(json_extract(b, '$.arguments') as varchar)")} || ', \"name\": \"' || json_extract_string(b, '$.name') || '\"}}' || chr(10) || '</tool_call>'"
_RENDERED = f"array_to_string(list_transform({_R_BLOCKS}, lambda b: {_CALL}), chr(10))"


def _unified(name: str, source: str) -> str:
    """Common table expressions: ``name`` has the parts of the column ``r`` of ``source``."""
    return f"""{name}0 as (select *, {_cut(_x('r', '<think>(.*?)</think>'))} as thought, len({_R_BLOCKS}) > 0 as has, {_bare('r')} as bare from {source}),
{name}1 as (select *, coalesce(lower({_x('r', _ACT_XML)}), lower({_x('r', _LOOSE)}), lower({_x('thought', _GIVEN)}), case when has then 'tool_call' end) as action,
  coalesce(upper({_x('r', _LAB_XML)}), upper({_x('r', _LOOSE, 2)}), upper({_x('thought', _GIVEN, 2)}), case when has then 'B' end) as given,
  case when has then {_RENDERED} else coalesce({_cut(_x('r', '<answer>(.*?)</answer>'))}, nullif(bare, '')) end as answer from {name}0),
{name} as (select *, coalesce(given, case action when 'direct_answer' then 'A' when 'tool_call' then 'B' when 'request_for_info' then 'C' when 'cannot_answer' then 'D' end) as label from {name}1)"""


_FORMS = _unified("u", f"(select conv_id, turn, gt_letter, {_cut('response')} as r from responses)")
_UNIFIED = """case when r = '' then r else trim(concat_ws(chr(10), case when thought <> '' then '<think>' || thought || '</think>' end, case when action <> '' then '<action>' || action || '</action>' end,
  case when label <> '' then '<label>' || label || '</label>' end, nullif(trim(coalesce(answer, bare), ' ' || chr(9) || chr(10) || chr(13)), '')), ' ' || chr(9) || chr(10) || chr(13)) end"""
_CANON = """case when coalesce(action, '') = '' or coalesce(label, '') = '' then coalesce(answer, '') else '<think>' || case when contains(coalesce(thought, ''), 'suggested_action') then thought
  else 'source=trajectory_or_when2call suggested_action=' || action || ' <' || label || '>' end || '</think>' || chr(10) || action || '<' || label || '>' || chr(10) || '<answer>' || coalesce(answer, '') || '</answer>' end"""
_REST = f"trim(regexp_replace(regexp_replace(regexp_replace(r, '{_LOOSE}', 'direct_answer<A>', 'i'), '</?answer>', '', 'gi'), '{_LOOSE}', '', 'gi'), ' ' || chr(9) || chr(10) || chr(13))"
_SURFACE = f"coalesce(answer, {_REST})"


def _per_unified(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """A text function over all responses, with SQL over their unified parts ``u``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixture(spark, sf_dir, "responses").select("conv_id", "turn", value(F.col("response")).alias("value"))

    QUERIES[name] = run
    ORACLES[name] = with_fixtures(sql)


@query(f"with {_FORMS} select conv_id, turn, action, label, thought, answer from u")
def d10_unified_parse(spark, sf_dir):
    r = F.col("response")
    df = fixture(spark, sf_dir, "responses").select("conv_id", "turn", tx.unified_parts(r, ss.rendered_tool_calls(r)).alias("p"))
    return df.select("conv_id", "turn", *[F.col(f"p.{c}").alias(c) for c in ("action", "label", "thought", "answer")])


_per_unified("d11_normalize", lambda c: tx.normalized(c, ss.rendered_tool_calls(c)), f"with {_FORMS} select conv_id, turn, {_UNIFIED} as value from u")
_per_unified("d16_canonical", lambda c: tx.canonical_output(c, ss.rendered_tool_calls(c)), f"with {_FORMS} select conv_id, turn, {_CANON} as value from u")
# The unified form has no answer tag, so that the canonical one's answer is the text without wrappers.
_V = _unified("v", f"(select conv_id, turn, {_UNIFIED} as r from u)")
_per_unified(
    "d17_reward_input",
    lambda c: tx.reward_input(c, ss.rendered_tool_calls(c)),
    f"with {_FORMS}, {_V} select conv_id, turn, case when r <> '' and action is not null and label is not null and answer is not null then {_CANON} else r end as value from v",
)
_per_unified("d19_forced_surface", lambda c: tx.forced_surface(c, "A", ss.rendered_tool_calls(c)), f"with {_FORMS} select conv_id, turn, {_SURFACE} as value from u")


@query(r"""select conv_id, turn, json_extract_string(b, '$.name') as tool_name, json_extract_string(b, '$.arguments.id') as arg_id
from (select conv_id, turn, unnest(regexp_extract_all(response, '<tool_call>\s*(.*?)\s*</tool_call>', 1, 'is')) as b from responses)""")
def d12_tool_blocks(spark, sf_dir):
    df = fixture(spark, sf_dir, "responses").select("conv_id", "turn", F.explode(tx.tool_calls(F.col("response"))).alias("c"))
    return df.select("conv_id", "turn", F.col("c.name").alias("tool_name"), F.get_json_object("c.arguments", "$.id").alias("arg_id"))


@query(f"select conv_id, turn, {_RENDERED} as value from (select conv_id, turn, response as r from responses)")
def d13_render(spark, sf_dir):
    return fixture(spark, sf_dir, "responses").select("conv_id", "turn", ss.rendered_tool_calls("response").alias("value"))


@query(f"select conv_id, turn, case when len({_R_BLOCKS}) > 0 then {_RENDERED} else {_cut('r')} end as value from (select conv_id, turn, chosen_response as r from responses)")
def d14_surface(spark, sf_dir):
    return fixture(spark, sf_dir, "responses").select("conv_id", "turn", ss.tool_surface("chosen_response").alias("value"))


#: The instruction of a forced action.
_FORCED = """chr(10) || chr(10) || '[Forced Action]' || chr(10) || case gt_letter when 'B' then 'You MUST perform a tool call.' || chr(10) || 'You MUST output only <tool_call>...</tool_call> blocks.' || chr(10) || 'You MUST NOT output action tags, <answer> tags, or extra prose.'
  else 'You MUST output plain assistant text consistent with action ' || case gt_letter when 'A' then 'direct_answer' when 'C' then 'request_for_info' else 'cannot_answer' end || '<' || gt_letter || '>.' || chr(10) || 'You MUST NOT output action tags, <answer> tags, or any tool-call XML unless the action is tool_call<B>.' end || chr(10)"""


@query(f"select conv_id, turn, 'Choose an action.' || {_FORCED} || chr(10) || 'assistant: ' || response as value from responses")
def d20_prompt_suffix(spark, sf_dir):
    value = F.concat(F.lit("Choose an action."), tx.prompt_suffix(F.col("gt_letter")), F.lit("\nassistant: "), "response")
    return fixture(spark, sf_dir, "responses").select("conv_id", "turn", value.alias("value"))


@query(r"""select doc_id, cast(len(s) as bigint) as n_sentences, cast(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as bigint) as max_len
from (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as s from documents)""")
def d22_sentences(spark, sf_dir):
    df = fixture(spark, sf_dir, "documents").withColumn("s", tx.sentences(F.col("text")))
    longest = F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0))
    return df.select("doc_id", F.size("s").cast("long").alias("n_sentences"), longest.cast("long").alias("max_len"))


@query("select doc_id, cast(len(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) as bigint) as n_tokens from documents")
def d23_tokens(spark, sf_dir):
    return fixture(spark, sf_dir, "documents").select("doc_id", F.size(tx.f1_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"""select event_id, case event_id % 6 when 0 then '{{"k": ' || json_extract_string(cell, '$.k') || '}}' when 1 then '{{"k": ' || json_extract_string(cell, '$[0].k') || '}}'
  when 5 then '{{"gt_action": "' || json_extract_string(cell, '$.gt_action') || '", "turn_idx": ' || json_extract_string(cell, '$.turn_idx') || '}}' end as value from json_cells""")
def d24_json_from_text(spark, sf_dir):
    cells = fixture(spark, sf_dir, "json_cells")
    return cells.select("event_id", ss.object_in_text(F.concat(F.lit("Reply: "), "cell")).alias("value"))


_NESTED = "concat('Here: {\"n\": {\"id\": ', cast(event_id as varchar(20)), ', \"s\": \"}{\"}, \"cell\": ', cell, '} or ```json {\"bad\": ', case when event_id % 2 = 0 then '```' else '0}```' end)"


@query(f"""select event_id, case when event_id % 2 = 1 then '{{"bad": 0}}' when event_id % 6 = 0 then '{{"k": ' || json_extract_string(cell, '$.k') || '}}'
  else '{{"id": ' || event_id || ', "s": "}}{{"}}' end as value from json_cells""")
def d24_nested_json(spark, sf_dir):
    """Objects inside others, with braces in strings: a fenced object first, else the last innermost one."""
    cells = fixture(spark, sf_dir, "json_cells")
    return cells.select("event_id", ss.object_in_text(F.expr(_NESTED.replace("varchar(20)", "string"))).alias("value"))


@query("""select event_id, cast(json_extract_string(cell, '$.turn_idx') as bigint) as turn_idx, upper(trim(json_extract_string(cell, '$.gt_action'))) as gt_action
from json_cells where event_id % 6 = 5""")
def d25_label_parse(spark, sf_dir):
    cells = fixture(spark, sf_dir, "json_cells").withColumn("a", F.explode(annotate.parse_reply(F.col("cell"))))
    return cells.select("event_id", F.col("a.turn_idx").cast("long").alias("turn_idx"), F.col("a.gt_action").alias("gt_action"))


@query("""select conv_id, turn, case when conv_id % 4 = 1 then 'get_item' else '' end as name,
  case when conv_id % 4 = 1 then cast(conv_id % 10 as varchar) end as arg_id from responses""")
def d26_tool_args(spark, sf_dir):
    call = tx.tool_name_and_arguments(F.col("chosen_response"))
    return fixture(spark, sf_dir, "responses").select("conv_id", "turn", call["name"].alias("name"), F.get_json_object(call["arguments"], "$.id").alias("arg_id"))


def _any(text: str, cues) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(text, c.replace("'", "''")) for c in cues) + ")"


@query(f"""select conv_id, turn, contains(lower(response), '?') or {_any('lower(response)', tx.QUESTION_CUES)} as is_question,
  {_any('lower(response)', tx.REFUSAL_CUES)} as is_refusal from responses""")
def d27_cues(spark, sf_dir):
    r = F.col("response")
    return fixture(spark, sf_dir, "responses").select("conv_id", "turn", tx.is_question(r).alias("is_question"), tx.is_refusal(r).alias("is_refusal"))


@query(r"""select page_id, regexp_replace(regexp_replace(url || case when page_id % 2 = 0 then '/chat/completions/' else '' end, '/+$', ''), '/(chat/completions|completions|chat)$', '') as base from pages""")
def d28_chat_url(spark, sf_dir):
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/chat/completions/").otherwise(""))
    return fixture(spark, sf_dir, "pages").select("page_id", tx.chat_base_url(url).alias("base"))


@query("""select conv_id, 'Conversation:' || chr(10) || string_agg(role || ': ' || trim(text), chr(10) order by turn) || chr(10) || 'Which action comes next?' as prompt
from conversations group by conv_id""")
def d29_label_prompt(spark, sf_dir):
    arrays = turns.as_arrays(_conversations(spark, sf_dir))
    prompt = F.concat(F.lit("Conversation:\n"), turns.rendered_prompt(F.col("messages")), F.lit("\nWhich action comes next?"))
    return arrays.select("conv_id", prompt.alias("prompt"))


@query("select doc_id, 'q:' || md5(text) as question_key from documents")
def d30_question_key(spark, sf_dir):
    return fixture(spark, sf_dir, "documents").select("doc_id", uq.question_key(F.col("text")).alias("question_key"))


@query("select vec_id, cast(list_sum(list_transform(embedding, lambda x: cast(abs(x) > 0.1 as int))) as bigint) as n_ids, cast(len(embedding) as bigint) as n from embeddings")
def d31_token_ids(spark, sf_dir):
    ids = F.flatten(F.array(F.transform("embedding", lambda x: (F.abs(x) > F.lit(0.1)).cast("int"))))
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)
    return fixture(spark, sf_dir, "embeddings").select("vec_id", total.alias("n_ids"), F.size(ids).cast("long").alias("n"))


@query("""select event_id, case event_id % 5 when 0 then [event_id, 2] when 1 then [event_id] when 2 then [event_id, 7] when 3 then [7, event_id] else [] end as ids from events""")
def d31_nested_ids(spark, sf_dir):
    """Flat, nested and named lists of ids; a list with something else in it is empty."""
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    forms = ("[{}, 2.9]", "[[[{}], [5]]]", '{{"input_ids": [[{}, " 7 "]]}}', "[7, {}]", '[1, {}, null, "x"]')
    cell = F.coalesce(*[F.when(k == i, F.concat(*[x for p in [f.replace("{{", "{").replace("}}", "}").split("{}")] for x in (F.lit(p[0]), n, F.lit(p[1]))])) for i, f in enumerate(forms)])
    return fixture(spark, sf_dir, "events").select("event_id", uq.token_ids(cell).alias("ids"))


# Conversations and turns.


def _conversations(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def _turned(spark, sf_dir) -> DataFrame:
    return turns.user_turns(_conversations(spark, sf_dir))


def _marked(spark, sf_dir) -> DataFrame:
    return turns.user_turns(fixture(spark, sf_dir, "messages_marked"))


_T = """t as (select *, greatest(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) - 1, 0)::bigint as turn_idx from {})"""
_TC = _T.format("(select conv_id, turn, role, text as content from conversations)")
_TM = _T.format("messages_marked")


@query(f"with {_TC} select conv_id, turn, role, turn_idx from t")
def c1_user_turns(spark, sf_dir):
    return _turned(spark, sf_dir).select("conv_id", "turn", "role", "turn_idx")


@query(f"""with {_TM} select conv_id, turn_idx, coalesce(min_by(content, turn) filter (where role = 'user' and content <> ''), '') as user_text,
  count(*) filter (where role = 'assistant' and content <> '') as n_assistant,
  count(*) filter (where role = 'assistant' and contains(content, '<tool_call>')) as n_tool_calls,
  coalesce(sum(length(content)) filter (where role = 'assistant'), 0)::bigint as n_chars from t group by all""")
def c2_turn_summary(spark, sf_dir):
    s = turns.summary(_marked(spark, sf_dir))
    total = F.aggregate("assistant_texts", F.lit(0), lambda a, x: a + F.length(x))
    tools = F.size(F.filter("assistant_texts", lambda x: x.contains("<tool_call>")))
    return s.select("conv_id", "turn_idx", "user_text", F.size("assistant_texts").cast("long").alias("n_assistant"), tools.cast("long").alias("n_tool_calls"), total.cast("long").alias("n_chars"))


@query(f"""with {_TM} select conv_id, turn_idx, coalesce(string_agg('tool_' || (conv_id % 4) || ':' || conv_id, ',' order by turn) filter (where role = 'assistant' and contains(content, '<tool_call>')), '') as calls from t group by all""")
def c2_turn_calls(spark, sf_dir):
    """Names and arguments of the calls of each turn's assistant messages, in order."""
    s = turns.summary(_marked(spark, sf_dir))
    one = lambda c: F.concat(c["name"], F.lit(":"), F.get_json_object(c["arguments"], "$.id"))
    return s.select("conv_id", "turn_idx", F.array_join(F.transform("tool_calls", one), ",").alias("calls"))


@query(f"""with {_TC}, cut as (select conv_id, turn_idx, coalesce(min(turn) filter (where role = 'user'), max(turn)) as c from t group by all)
select cut.conv_id, cut.turn_idx, count(*) as n_msgs, sum(length(content))::bigint as n_chars
from cut join t on t.conv_id = cut.conv_id and t.turn <= cut.c group by all""")
def c3_prompt_prefix(spark, sf_dir):
    return turns.prompt_prefix(_turned(spark, sf_dir))


@query(f"""with {_TC} select a.conv_id, a.turn_idx, count(b.turn) as n_msgs, coalesce(sum(length(b.content)), 0)::bigint as n_chars
from (select distinct conv_id, turn_idx from t) a left join t b on a.conv_id = b.conv_id and b.turn_idx > a.turn_idx group by all""")
def c4_future_suffix(spark, sf_dir):
    return turns.future_suffix(_turned(spark, sf_dir))


@query(f"""with {_TM} select conv_id, turn_idx, min(turn) as turn, min_by(content, turn) as content from t where role = 'assistant' group by all""")
def c5_first_assistant(spark, sf_dir):
    return turns.first_assistant(_marked(spark, sf_dir))


@query(f"""with {_TM} select conv_id, turn_idx, coalesce(min(turn) filter (where contains(content, '<tool_call>')), max(turn)) as turn,
  coalesce(min_by(content, turn) filter (where contains(content, '<tool_call>')), max_by(content, turn)) as content,
  bool_or(contains(content, '<tool_call>')) as has_tool from t where role = 'assistant' group by all""")
def c6_tool_or_last(spark, sf_dir):
    return turns.tool_or_last(_marked(spark, sf_dir))


@query("select conv_id, string_agg(role || ': ' || trim(text), chr(10) order by turn) as prompt_text from conversations group by conv_id")
def c7_render_prompt(spark, sf_dir):
    return turns.as_arrays(_conversations(spark, sf_dir)).select("conv_id", turns.rendered_prompt(F.col("messages")).alias("prompt_text"))


@query("select conv_id, min_by(text, turn) filter (where role = 'user') as content from conversations group by conv_id")
def c8_first_user(spark, sf_dir):
    return turns.as_arrays(_conversations(spark, sf_dir)).select("conv_id", turns.first_user(F.col("messages")).alias("content"))


@query(f"with {_TC} select conv_id, turn_idx, max(turn) as end_pos from t group by all")
def c9_turn_end_positions(spark, sf_dir):
    return turns.end_positions(_turned(spark, sf_dir))


@query("select conv_id, coalesce(min(turn) filter (where role = 'user') + 1, 0) as n_msgs from conversations group by conv_id")
def b12_trim_first_user(spark, sf_dir):
    arrays = turns.as_arrays(_conversations(spark, sf_dir))
    return arrays.select("conv_id", F.size(turns.through_first_user(F.col("messages"))).cast("long").alias("n_msgs"))


# Classification.

_E2 = (
    f"case when {_any('lower(body)', classify.CANNOT_MARKERS)} then 'D' when contains(body, '?') and {_any('lower(body)', classify.CLARIFY_MARKERS)} then 'C' else 'A' end"
)
_BODY = "trim(regexp_replace(content, '<think>.*?</think>', '', 'gis'), ' ' || chr(10))"
_FIRST = f"f as (select conv_id, turn_idx, min_by(content, turn) as content from t where role = 'assistant' group by all), g as (select *, {_BODY} as body, contains(content, '<tool_call>') as has from f)"


@query(f"with {_TM}, {_FIRST} select conv_id, turn_idx, {_E2} as label from g")
def e2_classify(spark, sf_dir):
    kind = classify.turn_response(F.col("content"))
    return turns.first_assistant(_marked(spark, sf_dir)).select("conv_id", "turn_idx", kind["label"].alias("label"))


_CAND = f"""{_TM}, {_FIRST}, h as (select conv_id, turn_idx, has, body, case when has then 'B' else {_E2} end as gt_action from g where has or body <> '')"""


@query(f"""with {_CAND} select conv_id, turn_idx, gt_action,
  case gt_action when 'B' then 'observed_ready_to_execute' when 'D' then 'trajectory_refusal_or_capability_gap' when 'C' then 'observed_clarification_request' else 'observed_direct_answer' end as reason_type,
  case gt_action when 'A' then 'low' else 'medium' end as uq_target_type, body as target_answer from h""")
def e12_candidates(spark, sf_dir):
    return annotate.candidates(_marked(spark, sf_dir)).select("conv_id", "turn_idx", "gt_action", "reason_type", "uq_target_type", "target_answer")


@query(f"""with {_CAND}, n as (select conv_id, list_sort(list_distinct(list(regexp_extract(content, '"name":"([^"]*)"', 1)) filter (where contains(content, '"name":"')))) as names from messages_marked group by conv_id)
select h.conv_id, turn_idx, gt_action, array_to_string(case gt_action when 'B' then ['tool_' || (conv_id % 4)] when 'D' then coalesce(names, []) else [] end, ',') as relevant_tools, 0 as n_slots,
  case gt_action when 'B' then 'The observed assistant next action is a concrete tool call with available arguments.' else 'The observed assistant next action is a non-tool response at this turn.' end as rationale,
  body as chosen_response from h join n using (conv_id)""")
def e12_relevant_tools(spark, sf_dir):
    """Candidates with the tools they call, or all of the conversation's where they cannot answer."""
    calls = fixture(spark, sf_dir, "messages_marked").select("conv_id", F.explode_outer(tx.tool_calls(F.coalesce("content", F.lit("")))).alias("c"))
    tools = calls.groupBy("conv_id").agg(F.array_sort(F.collect_set("c.name")).alias("tool_names"))
    out = annotate.candidates(_marked(spark, sf_dir), tools)
    return out.select("conv_id", "turn_idx", "gt_action", F.array_join("relevant_tools", ",").alias("relevant_tools"), F.size("missing_slots").alias("n_slots"), "rationale", "chosen_response")


@query(f"""with {_CAND}, l as (select unnest(['A', 'B', 'C', 'D']) as gt_action) select l.gt_action, count(h.conv_id) as n from l left join h using (gt_action) group by all""")
def g2_turn_label_counts(spark, sf_dir):
    return sampling.label_counts(annotate.candidates(_marked(spark, sf_dir)))


def _pattern(items) -> str:
    return "|".join(items).replace("'", "''")


@query(f"""select conv_id, turn, category, case category when 'direct' then 'A' when 'tool_call' then 'B' when 'request_for_info' then 'C' else 'D' end as letter
from (select conv_id, turn, case when trim(chosen_response) = '' then 'direct'
  when contains(lower(chosen_response), '<toolcall>') or contains(lower(chosen_response), '<tool_call>') or contains(chosen_response, '"name":') then 'tool_call'
  when regexp_matches(chosen_response, '{_pattern(classify.REFUSAL_PATTERNS)}', 'i') then 'cannot_answer'
  when regexp_matches(chosen_response, '{_pattern(classify.QUESTION_PATTERNS)}', 'i') then 'request_for_info' else 'direct' end as category from responses)""")
def e1_classify_pref(spark, sf_dir):
    df = fixture(spark, sf_dir, "responses").withColumn("category", classify.preference_category(F.col("chosen_response")))
    return df.select("conv_id", "turn", "category", classify.category_letter(F.col("category")).alias("letter"))


_CM2 = "((starts_with(data_source, 'cm2') and data_source <> 'cm2_turn_action') or data_source = 'nvidia_nemotron_checklist')"


@query(f"select row_id, {_CM2} as flag from mixed_rows")
def e3_is_cm2(spark, sf_dir):
    return fixture(spark, sf_dir, "mixed_rows").select("row_id", classify.is_trajectory_source(F.col("data_source")).alias("flag"))


@query(f"select row_id, data_source from mixed_rows where {_CM2} and row_id in (select row_id from mixed_annotations)")
def e4_annotated_only(spark, sf_dir):
    return annotate.annotated_only(fixture(spark, sf_dir, "mixed_rows"), fixture(spark, sf_dir, "mixed_annotations")).select("row_id", "data_source")


@query("select event_id, upper(trim(json_extract_string(cell, '$.gt_action'))) as label from json_cells where event_id % 6 = 5")
def e5_valid_actions(spark, sf_dir):
    cells = fixture(spark, sf_dir, "json_cells").withColumn("label", classify.valid_label(F.get_json_object("cell", "$.gt_action")))
    return cells.where("label is not null").select("event_id", "label")


@query("select conv_id, text as content from conversations where role = 'user' and text <> '' qualify row_number() over (partition by conv_id order by turn) = 1")
def e6_null_result_filter(spark, sf_dir):
    made = turns.as_arrays(_conversations(spark, sf_dir)).select("conv_id", turns.first_user(F.col("messages")).alias("content"))
    return made.where("content is not null")


@query(r"select doc_id, n_tokens from (select doc_id, cast(len(regexp_extract_all(text, '\S+')) as bigint) as n_tokens from documents) where n_tokens <= 512")
def e7_overlong(spark, sf_dir):
    df = fixture(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_tokens"))
    return df.where("n_tokens <= 512")


@query(r"""select doc_id, source, n_tokens from (select doc_id, source, cast(len(regexp_extract_all(text, '\S+')) as bigint) as n_tokens from documents)
where n_tokens <= least(640, greatest(1, least(700, 1000) - 256))""")
def e7_prompt_limit(spark, sf_dir):
    """Documents as prompts within the limit that a rollout's settings leave beside a response."""
    settings = {"ROLLOUT_MAX_MODEL_LEN": "700", "ROLLOUT_MAX_BATCHED_TOKENS": "1000"}
    df = fixture(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return prompts.within_limit(df, prompts.whitespace_length(F.col("text")), prompts.prompt_limit(640, 256, settings)).drop("text")


@query("select row_id, data_source from mixed_rows where row_id not in (select row_id from mixed_annotations) order by row_id limit 100")
def e9_pending(spark, sf_dir):
    rows, notes = fixture(spark, sf_dir, "mixed_rows"), fixture(spark, sf_dir, "mixed_annotations")
    return merge.pending(rows, notes, 100).select("row_id", "data_source")


@query(f"select row_id, case when {_CM2} then 'trajectory' else 'action' end as branch from mixed_rows")
def e10_route(spark, sf_dir):
    rows = fixture(spark, sf_dir, "mixed_rows")
    return rows.select("row_id", F.when(classify.is_trajectory_source(F.col("data_source")), "trajectory").otherwise("action").alias("branch"))


@query(f"""with {_TC}, n as (select conv_id, max(turn_idx) + 1 as k from t group by all), a as (select conv_id, turn as turn_idx, case turn % 3 when 0 then ' a' when 1 then 'B' else 'x' end as gt from conversations)
select a.conv_id, a.turn_idx, upper(trim(gt)) as gt_action from a join n using (conv_id) where turn_idx < k and upper(trim(gt)) in ('A', 'B', 'C', 'D')""")
def e11_valid_annotations(spark, sf_dir):
    counts = turns.end_positions(_turned(spark, sf_dir)).groupBy("conv_id").agg((F.max("turn_idx") + 1).alias("k"))
    gt = F.when(F.col("turn") % 3 == 0, " a").when(F.col("turn") % 3 == 1, "B").otherwise("x")
    notes = _conversations(spark, sf_dir).select("conv_id", F.col("turn").alias("turn_idx"), classify.valid_label(gt).alias("gt_action"))
    return notes.join(counts, "conv_id").where("turn_idx < k and gt_action is not null").drop("k")


@query("""select event_id, cast(event_id % 5 as int) as turn_idx, case when event_id % 2 = 0 then 'A' else 'B' end as gt_action,
  case when event_id % 2 = 0 then 'direct_answer' else 'tool_call' end as gt_action_name, 'ambiguous' as uq_target_type, 'other' as reason_type, '' as chosen_response, true as use_uq_reward
from json_cells where event_id % 6 = 5""")
def e13_normalize_annotation(spark, sf_dir):
    cells = fixture(spark, sf_dir, "json_cells").withColumn("a", annotate.normal_form(F.col("cell"))).where("a is not null")
    return cells.select("event_id", "a.turn_idx", "a.gt_action", "a.gt_action_name", "a.uq_target_type", "a.reason_type", "a.chosen_response", "a.use_uq_reward")


@query("select event_id, event_type, value, user_id % 2 = 0 as flag from events where event_type is not null")
def e14_metric_columns(spark, sf_dir):
    df = fixture(spark, sf_dir, "events").where("event_type is not null").withColumn("flag", F.col("user_id") % 2 == 0)
    simple = [c for c, kind in df.dtypes if kind in ("string", "boolean", "double") and c != "props"]
    return df.select("event_id", *simple)
