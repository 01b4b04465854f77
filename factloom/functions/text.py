"""Text expressions: tokens, query classes, parsers of replies and dialogues, identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of query classes, tested in this order as substrings.
QUERY_CLASSES = {
    "temporal": (
        "kapan", "tanggal", "waktu", "sejak", "sampai", "selama", "sebelum", "sesudah", "setelah", "bulan", "tahun",
        "minggu", "kemarin", "besok", "lusa", "dulu", "baru-baru ini",
    ),
    "causal": ("kenapa", "mengapa", "karena", "sebab", "akibat", "penyebab", "alasan", "sehingga", "dampak"),
    "aggregation": ("berapa kali", "berapa banyak", "total", "jumlah", "seberapa sering", "rata-rata", "semua", "seluruh"),
    "comparison": ("beda", "perbedaan", "sama", "dibanding", "versus", "lebih", "kurang", "mirip"),
}
MULTI_HOP = ("causal", "comparison")


def tokens(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row: inside a lambda an expression is computed
    again for every element, but the only element of an array is not."""
    return F.transform(F.array(value), then)[0]


def overlap(words: Column, wanted: Column) -> Column:
    """Share of ``wanted`` that ``words`` holds; null for no wanted words."""
    return once(wanted, lambda own: F.try_divide(F.size(F.array_intersect(words, own)).cast("double"), F.size(own)))


def classify_query(text: Column) -> Column:
    """The first class with a keyword in the text, else ``factual``."""
    low, chosen = F.lower(text), None
    for name, words in QUERY_CLASSES.items():
        test = F.rlike(low, F.lit("|".join(words)))
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return chosen.otherwise("factual")


def entity_candidates(text: Column) -> Column:
    """Words of more than two characters that start with an upper-case letter, in order."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.rlike(w, F.lit(r"^\p{Lu}")) & (F.length(w) > 2))


def entity_id(group: Column, name: Column) -> Column:
    return F.substring(F.regexp_replace(F.concat_ws("_", group, name), "[^a-zA-Z0-9_]", "_"), 1, 180)


def passage_id(collection: Column, doc_id: Column) -> Column:
    """Key of a passage: the collection is part of it."""
    return F.concat_ws("/", collection, F.substring(F.regexp_replace(doc_id, r"[^\p{L}\p{N}_-]", "_"), 1, 180))


def strip_fence(reply: Column) -> Column:
    """The body of a fenced block with an optional language word; other text only trimmed."""
    body = F.regexp_extract(reply, r"(?s)^\s*```(?:[a-zA-Z]+)?\s*(.*?)\s*```", 1)
    return F.when(F.rlike(reply, F.lit(r"(?s)^\s*```.*```")), body).otherwise(F.trim(reply))


def first_object(reply: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


DIALOGUE = r"(?i)^(Bot|User):\s*(.*)"


def dialogue_turns(script: Column) -> Column:
    """Array of (speaker, text) of the lines that name a speaker."""
    lines = F.filter(F.split(script, "\n"), lambda x: F.rlike(x, F.lit(DIALOGUE)))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, DIALOGUE, 1)).alias("speaker"), F.trim(F.regexp_extract(x, DIALOGUE, 2)).alias("text")))


def is_sufficient(reply: Column) -> Column:
    return F.rlike(F.upper(reply), F.lit("CUKUP: ?YA"))


def missing_hint(reply: Column) -> Column:
    """First line after the last INFO_KURANG: mark, else empty."""
    return F.regexp_extract(reply, r"(?s).*INFO_KURANG:\s*([^\n]*)", 1)


def session_number(name: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(F.lower(name), r"session_(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long")


def needle(fact: Column) -> Column:
    """The part of a fact that is looked up in stored texts."""
    return F.substring(F.replace(F.regexp_replace(fact, r"^\[(FACT|DETAIL)\]\s*", ""), F.lit('"'), F.lit("")), 1, 120)


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def model_name(model: Column) -> Column:
    return F.regexp_replace(model, "models/", "")


def hosted_model(model: Column) -> Column:
    return F.when(F.startswith(model, F.lit("google/")), model).otherwise(F.concat(F.lit("google/"), model))


def fallback_summary(user_texts: Column) -> Column:
    """Summary from a session's user turns, in order."""
    n = F.size(user_texts)
    first, last = F.try_element_at(user_texts, F.lit(1)), F.try_element_at(user_texts, F.lit(-1))
    return (
        F.when(n >= 2, F.concat(F.lit("Percakapan tentang: "), F.left(first, F.lit(50)), F.lit("... hingga "), F.left(last, F.lit(50)), F.lit("...")))
        .when(n == 1, F.concat(F.lit("Percakapan singkat tentang: "), F.left(first, F.lit(100)), F.lit("...")))
        .otherwise("Percakapan antara bot dan user.")
    )


def parse_facts(reply: Column, body: Column, reference_time: Column) -> Column:
    """Array of (fact, entities, valid_at) from a reply in JSON.

    A list, an object with a list under facts, items or data, or one object; keys fact or fakta,
    entities or entitas; a missing time is the reference time; what cannot be parsed is one fact,
    the first 2000 characters of ``body``. Blank facts are dropped.
    """
    from factloom.schemas import FACT_JSON

    clean = strip_fence(reply)
    one = FACT_JSON.removeprefix("array<").removesuffix(">")
    wrapped = F.from_json(clean, f"facts {FACT_JSON}, items {FACT_JSON}, data {FACT_JSON}")
    parsed = F.when(F.startswith(clean, F.lit("[")), F.from_json(clean, FACT_JSON)).when(
        F.startswith(clean, F.lit("{")) & F.try_parse_json(clean).isNotNull(), F.coalesce(wrapped["facts"], wrapped["items"], wrapped["data"], F.array(F.from_json(clean, one)))
    )
    raw = F.array(F.struct(F.left(body, F.lit(2000)).alias("fact"), F.array().cast("array<string>").alias("entities"), reference_time.alias("valid_at")))
    named = F.transform(
        parsed,
        lambda f: F.struct(
            F.coalesce(f["fact"], f["fakta"], F.lit("")).alias("fact"),
            F.coalesce(f["entities"], f["entitas"], F.array().cast("array<string>")).alias("entities"),
            F.coalesce(F.try_to_timestamp(f["valid_at"]), reference_time).alias("valid_at"),
        ),
    )
    return F.filter(F.coalesce(named, raw), lambda f: F.trim(f["fact"]) != "")


def first_entity(names: Column) -> Column:
    """The first of a fact's entity names, null without any."""
    return F.try_element_at(names, F.lit(1))
