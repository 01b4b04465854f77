"""Schemas of stored tables and of the JSON documents that are read, as Spark schema strings."""

from __future__ import annotations

import re


def fields(schema: str) -> list[str]:
    """Column names of a schema written as text."""
    return [part.strip().split(" ")[0] for part in re.sub(r"<[^<>]*>", "", _flat(schema)).split(",")]


def _flat(schema: str) -> str:
    while re.search(r"<[^<>]*<", schema):
        schema = re.sub(r"<[^<>]*>", "", schema)
    return schema


EPISODE = ("episode_id string, group_id string, name string, body string, source_description string, reference_time timestamp, created_at timestamp")
FACT = ("fact_id string, group_id string, episode_name string, fact_text string, embedding array<float>, entity_names array<string>, valid_at timestamp, created_at timestamp, source_description string")
ENTITY = ("entity_id string, group_id string, name string, created_at timestamp")
EDGE = ("in_id string, out_id string")
PASSAGE = ("passage_id string, collection string, doc_id string, text string, embedding array<float>, metadata map<string,string>, created_at timestamp")

TURN = "struct<speaker:string,text:string,timestamp:string>"
EVENT = "struct<id:string,date:string,description:string,caused_by:array<string>>"
GROUND_TRUTH = (
    "struct<turn_id:int,session_id:int,speaker:string,factual:array<struct<fact:string,confidence:double,category:string>>,"
    "entities_mentioned:array<struct<name:string,type:string,context:string>>,"
    "temporal_references:array<struct<type:string,value:string,text:string>>,"
    "retrieval_required:array<struct<info_type:string,description:string>>>"
)
SESSION = f"struct<session_id:int,date:string,datetime:string,turns:array<{TURN}>,summary:string,relevant_events:array<{EVENT}>,ground_truths:array<{GROUND_TRUTH}>>"
EVENTS = ("id string, date string, description string, caused_by array<string>")
QUERY = (
    "id string, query string, type string, difficulty string, expected_answer string, required_context string, "
    "reasoning_steps string, relevant_sessions array<int>, is_cross_session boolean, source string"
)
PERSONA = (
    "user struct<name:string,age:int,occupation:string,location:string,traits:array<string>,hobbies:array<string>,interests:array<string>,conversation_topics:array<string>,backstory:string>,"
    "secondary_personas array<struct<name:string,relationship:string,traits:array<string>>>"
)
COST = ("timestamp double, setup string, model string, input_tokens long, output_tokens long, cost_usd double, call_type string")
FACT_JSON = "array<struct<fact:string,fakta:string,entities:array<string>,entitas:array<string>,valid_at:string>>"
RERANK_JSON = "array<struct<passage_id:int,score:double,reason:string>>"
HIT = ("qid long, fact_id string, fact_text string, score double, entity_names array<string>")
JUDGE_JSON = ("score double, information_presence double, completeness double, temporal_info double, no_contradiction double, reasoning string, missing_info array<string>")
