"""Test inputs of the reference's record shapes, as projections of the driver tables in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {
    "messages_marked": """
select conv_id, turn, role,
  case when role <> 'assistant' then text
       when (conv_id * 7 + turn) % 5 = 1 then concat('<tool_call>{"name":"tool_', cast(conv_id % 4 as varchar(20)), '","arguments":{"id":', cast(conv_id as varchar(20)), '}}</tool_call>')
       when (conv_id * 7 + turn) % 5 = 2 then concat(text, ' Could you provide more details?')
       when (conv_id * 7 + turn) % 5 = 3 then concat('Sorry, ', text)
       when (conv_id * 7 + turn) % 5 = 4 then concat('<think>plan</think> ', text)
       else text end as content
from conversations""",
    "responses": """
select conv_id, turn,
  case cast(conv_id % 4 as int) when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end as gt_letter,
  case cast((conv_id * 3 + turn) % 6 as int)
    when 0 then concat('<think>source=known fact suggested_action=direct_answer<A></think>', chr(10), 'direct_answer<A>', chr(10), '<answer>', text, '</answer>')
    when 1 then concat('<think>source=tool fits suggested_action=tool_call<B></think>', chr(10), 'tool_call<B>', chr(10), '<answer><tool_call>{"name": "get_item", "arguments": {"id": ', cast(conv_id as varchar(20)), '}}</tool_call></answer>')
    when 2 then concat('<think>source=gap suggested_action=request_for_info<C></think>', chr(10), 'request_for_info<C>', chr(10), '<answer>Could you provide ', text, '?</answer>')
    when 3 then concat('<think>source=no access suggested_action=direct_answer<A></think>', chr(10), 'cannot_answer<D>', chr(10), '<answer>Sorry, I cannot do ', text, '</answer>')
    when 4 then text
    else concat('[uq]internal_uq=0.4 external_uq=0.2 source=legacy note suggested_action=<C>[/uq] [answer]', text, ' request_for_info<C>[/answer]') end as response,
  case cast(conv_id % 4 as int)
    when 1 then concat('<tool_call>{"name": "get_item", "arguments": {"id": ', cast(conv_id % 10 as varchar(20)), '}}</tool_call>')
    when 2 then concat('Could you provide ', text, '?')
    when 3 then concat('Sorry, I cannot do ', text)
    else text end as chosen_response
from conversations where role = 'assistant'""",
    "rollouts": """
select event_id, user_id, concat('idx:', cast(user_id as varchar(20))) as group_key,
  concat('idx:', cast(event_id as varchar(20))) as rollout_key,
  case event_type when 'click' then 'A' when 'view' then 'B' when 'purchase' then 'C' when 'signup' then 'D' else '' end as pred_letter,
  case cast(user_id % 4 as int) when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end as gt_letter,
  round(exp(value / 100.0e0), 6) as seq_ppl, ts
from events""",
    "mixed_rows": """
select doc_id as row_id,
  case lang when 'en' then 'cm2_main' when 'fr' then 'when2call_pref' when 'de' then 'cm2_turn_action' else 'nvidia_nemotron_checklist' end as data_source,
  source as original_index, n_chars
from documents""",
    "mixed_annotations": """
select doc_id as row_id, 0 as turn_idx,
  case when quality = 1 and toxic = 0 then 'A' when quality = 0 and toxic = 0 then 'B' when quality = 1 then 'C' else 'D' end as gt_action
from labels
union all
select doc_id as row_id, 1 as turn_idx, 'C' as gt_action from labels where doc_id % 5 = 0""",
    "json_cells": """
select event_id,
  case cast(event_id % 6 as int)
    when 0 then props
    when 1 then concat('[', props, ']')
    when 2 then 'not json'
    when 3 then ''
    when 4 then '"text"'
    else concat('{"turn_idx":', cast(event_id % 5 as varchar(20)), ',"gt_action":"', case when event_id % 2 = 0 then 'a' else 'B ' end, '"}') end as cell
from events""",
    "tool_cells": """
select c_custkey as id,
  case cast(c_custkey % 6 as int)
    when 0 then concat('[{"type":"function","function":{"name":"f', cast(c_custkey % 7 as varchar(20)), '","description":"d","parameters":{}}}]')
    when 1 then '[{"name":"look_up"},{"bad":1},{"name":"open","description":"o"}]'
    when 2 then '{"name":"single"}'
    when 3 then 'oops'
    when 4 then '[]'
    else null end as tools
from customer""",
    "extra_cells": """
select o_orderkey as id,
  case cast(o_orderkey % 5 as int)
    when 0 then concat('{"gt_letter":"A","keep":', cast(o_orderkey as varchar(20)), ',"use_uq_reward":true}')
    when 1 then '{"uq_target_type":"low","chosen_response":"x"}'
    when 2 then '{}'
    when 3 then 'broken'
    else '{"keep":1,"tools":[{"name":"t"}]}' end as extra,
  case cast(o_orderkey % 3 as int) when 0 then '[]' when 1 then '[{"name":"own"}]' else null end as tools,
  case cast(o_orderkey % 7 as int) when 0 then ' Yes ' when 1 then 'true' when 2 then '0' when 3 then 'on' when 4 then '' when 5 then null else 'no' end as flag
from orders""",
}

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_FROM = re.compile(rf"\b(from|join)\s+({'|'.join(_TABLES)})\b")


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the driver tables by path, without views."""
    return spark.sql(_FROM.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in FIXTURES:
        return spark_sql(spark, sf_dir, FIXTURES[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fixtures(body: str) -> str:
    """DuckDB SQL with the fixtures that it names as leading common table expressions."""
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", body)]
    head = ",\n".join(f"{n} as ({FIXTURES[n]})" for n in used)
    body = body.strip()
    if not head:
        return body
    return f"with {head},\n{body[5:]}" if body.lower().startswith("with ") else f"with {head}\n{body}"
