"""Personal data: patterns, and information-theoretic sanitisation of the words that reveal it.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Each found value is a
protected entity, and so is what several values share: an e-mail domain, the first three parts of an
IP address, a card's first six digits, a phone number's first five. The terms of a text that holds
the entity, anywhere outside its found values, are the entity's context, and the corpus tells how
much they reveal: with N texts, of which n_c hold the entity, n_t the term, and n_ct both, a term
discloses the share

    PMI(entity; term) / IC(entity) = log(n_ct * N / (n_c * n_t)) / log(N / n_c)

of the entity's information. In a text that holds the entity, terms that disclose ``GENERALISE`` or
more are replaced by their class (a number, a code, a name, a word), and terms that disclose ``REMOVE``
or more are removed. A term that meets an entity in fewer than ``SUPPORT`` texts is left alone: it is
no evidence. Texts without a found value are never changed.

Everything is DataFrame functions. Only hashes of texts, entities and terms are written to the shared
folder, never the personal data. Terms are counted before they meet entities: one whose count in the
texts with found values is too large for the threshold drops out, and so does one below the support.
One pass over the corpus counts the candidates that are left. Positions are code points, ends
exclusive.

Cases: null and empty texts have no spans; repeated rows and equal texts get equal spans and count
as one text in the statistics; with no found value, or no term with enough support, only the
patterns act; an empty table gives an empty table; columns beyond the id and the text are carried
along only if named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import forget, saved, text_of

GENERALISE, REMOVE, SUPPORT = 0.9, 0.99, 2
#: A table of term hashes is broadcast up to this many rows; beyond it is joined by shuffle.
BROADCAST_TERMS = 1 << 20
KINDS = ("email", "ip", "card", "phone")
#: Letters and digits; terms of one character reveal nothing by themselves.
TERM, LEAST_TERM = r"[\p{L}\p{N}]+", 2
#: Matches that are placed in one go.
CHUNK = 512
SPANS = "array<struct<start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Pattern:
    """A kind's pattern, written so that the matcher never goes back: possessive repeats, and a start
    that no earlier character could extend. ``hint`` is a cheap test that every match passes."""

    kind: str
    regex: str
    hint: str

    def possible(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.hint)) if len(self.hint) == 1 else F.rlike(text, F.lit(self.hint))


PATTERNS = (
    Pattern("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Pattern("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    Pattern("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(at, F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def matches(text: Column, regex: Column, valid=lambda value: F.lit(True)) -> Column:
    """Spans of the non-overlapping matches that are valid: the pieces between matches give the places.

    An array that grows by one is copied each time, so matches go by chunks, each from its own start."""
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("piece"), F.regexp_extract_all(text, regex, 0).alias("value"))
    length = lambda pair: F.length(pair["piece"]) + F.coalesce(F.length(pair["value"]), F.lit(0))

    def spans(chunk: Column, begin: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            at, value = state["at"] + F.length(pair["piece"]), pair["value"]
            end = state["at"] + length(pair)
            span = F.array(F.struct(at.alias("start"), end.alias("end"), value.alias("value")))
            return F.struct(end.alias("at"), F.when(value.isNotNull() & valid(value), F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), F.array().cast(SPANS).alias("found")), step, lambda state: state["found"])

    def chunked(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda total, pair: total + length(pair)))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda found, n: F.concat(found, F.array(F.element_at(found, -1) + n)))
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("pairs"), F.slice(begins, F.lit(1), F.size(chunks)).alias("begin")), lambda c: spans(c["pairs"], c["begin"])))

    # one evaluation of the pairs: they are the only element of an array
    return F.transform(F.array(pairs), lambda p: F.when(F.size(p) <= CHUNK, spans(p, F.lit(0))).otherwise(chunked(p)))[0]


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind; texts without the kind's hint are not searched."""
    none = F.array().cast(SPANS)
    return {p.kind: F.when(p.possible(text), matches(text, F.lit(p.regex), lambda v, k=p.kind: _valid(k, v))).otherwise(none) for p in PATTERNS}


def any_hint(text: Column) -> Column:
    test = F.lit(False)
    for p in PATTERNS:
        test = test | p.possible(text)
    return test


def entities(spans: dict[str, Column]) -> Column:
    """Distinct names of the values found, and of what values share."""

    def named(kind: str) -> Column:
        def both(s: Column) -> Column:
            value = F.lower(s["value"])
            shared = {"email": F.substring_index(value, "@", -1), "ip": F.substring_index(value, ".", 3), "card": F.left(_digits(value), F.lit(6)), "phone": F.left(_digits(value), F.lit(5))}[kind]
            return F.array(F.concat(F.lit(f"{kind}:"), value), F.concat(F.lit(f"{kind} group:"), shared))

        return F.flatten(F.transform(spans[kind], both))

    return F.array_distinct(F.concat(*map(named, KINDS)))


def terms(text: Column) -> Column:
    """Distinct lower-case terms."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)), lambda w: F.length(w) >= LEAST_TERM)


def hashed(names: Column) -> Column:
    return F.transform(names, lambda x: F.xxhash64(x))


def term_counts(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, n_out): number of distinct ``texts`` (key, text) that hold each candidate term."""
    found = texts.select("key", F.explode(hashed(terms(F.col("text")))).alias("term"))
    few = F.broadcast(candidates) if candidates.count() <= BROADCAST_TERMS else candidates
    return found.join(few, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_out"))


def disclosures(exposed: DataFrame, others: DataFrame, total: int, support: int = SUPPORT, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, term, removed): hashes of the terms to sanitise in each exposed text.

    ``exposed``: key, entities and terms (hashes), one row a text; ``others``: key and text of the rows
    without a found value; ``total``: number of distinct texts.
    """
    held = exposed.select("key", F.explode("entities").alias("entity"))
    n_c = saved(held.groupBy("entity").agg(F.count("*").alias("n_c")).where((F.col("n_c") >= support) & (F.col("n_c") < total)), "pii-entities")
    said = exposed.select("key", F.explode("terms").alias("term"))
    # the threshold says: n_t <= n_ct * (N / n_c) ** (1 - threshold), and n_ct is at most n_c and n_t's
    # part in the exposed texts, n_low; what is common there needs no pass over the corpus
    most = F.col("n_c") * F.pow(F.lit(float(total)) / F.col("n_c"), F.lit(1 - threshold)) * (1 + 1e-9)
    highest = n_c.agg(F.max(most)).first()[0] or 0.0
    n_low = saved(said.groupBy("term").agg(F.count("*").alias("n_low")).where((F.col("n_low") >= support) & (F.col("n_low") <= highest)), "pii-terms")
    pairs = held.join(n_c, "entity").join(said.join(n_low, "term"), "key").where(F.col("n_low") <= most)
    pairs = saved(pairs.select("key", "entity", "term", "n_c", "n_low"), "pii-pairs")
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_low").alias("n_low"))
    reach = F.col("n_ct") * F.pow(F.lit(float(total)) / F.col("n_c"), F.lit(1 - threshold)) * (1 + 1e-9)
    joint = saved(joint.where((F.col("n_ct") >= support) & (F.col("n_low") <= reach)), "pii-joint")
    n_out = saved(term_counts(others, joint.select("term").distinct()), "pii-counts")
    n_t = F.col("n_low") + F.coalesce("n_out", F.lit(0))
    share = F.log(F.col("n_ct") * F.lit(float(total)) / (F.col("n_c") * n_t)) / F.log(F.lit(float(total)) / F.col("n_c"))
    risky = joint.join(n_out, "term", "left").withColumn("share", share).where(F.col("share") >= threshold)
    risky = saved(risky.select("entity", "term", (F.col("share") >= remove).alias("removed")), "pii-risky")
    out = saved(pairs.join(risky, ["entity", "term"]).groupBy("key", "term").agg(F.max("removed").alias("removed")), "pii-risk")
    forget(n_c, n_low, pairs, joint, n_out, risky)
    return out


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """One evaluation of ``value``: it is the only element of an array."""
    return F.transform(F.array(value), then)[0]


def _chunks(spans: Column) -> Column:
    """An array in parts of ``CHUNK`` elements."""
    last = F.floor((F.size(spans) - 1) / CHUNK).cast("int")
    return F.when(F.size(spans) == 0, F.array(spans)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(spans, i * CHUNK + 1, F.lit(CHUNK))))


def _outside(spans: Column, base: list[str]) -> Column:
    """Spans that overlap no span of a pattern. Those are looked up in parts, by the part's bounds first."""
    taken = F.array_sort(F.concat(*[F.transform(k, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))) for k in base]))

    def bounded(part: Column) -> Column:
        return F.struct(part[0]["start"].alias("start"), F.array_max(F.transform(part, lambda b: b["end"])).alias("end"), part.alias("spans"))

    def free(parts: Column) -> Column:
        meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
        return F.filter(spans, lambda s: ~F.exists(parts, lambda p: F.coalesce(meet(s, p), F.lit(False)) & F.exists(p["spans"], lambda b: meet(s, b))))

    return _bind(_bind(taken, lambda t: F.transform(_chunks(t), bounded)), free)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, label; sorted) replaced by its label; of overlapping spans the
    first start gives the label.

    A substring is found by walking from the start of its text. So the spans go in parts, and each part walks
    its own piece of the text: the cost is the length times the root of the number of spans, or so."""

    def part_of(state: Column, part: Column) -> Column:
        until = F.greatest(state["at"], F.array_max(F.transform(part, lambda s: s["end"])))

        def within(piece: Column) -> Column:
            def step(inner: Column, span: Column) -> Column:
                fresh = span["start"] >= inner["at"]
                more = F.array(F.substring(piece, inner["at"] - state["at"] + 1, span["start"] - inner["at"]), span["label"])
                return F.struct(F.greatest(inner["at"], span["end"]).alias("at"), F.when(fresh, F.concat(inner["parts"], more)).otherwise(inner["parts"]).alias("parts"))

            return F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("parts")), step, lambda s: F.array_join(s["parts"], ""))

        done = _bind(F.substring(text, state["at"] + 1, until - state["at"]), within)
        return F.struct(until.alias("at"), F.concat(state["parts"], F.array(done)).alias("parts"))

    def whole(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(_chunks(spans), start, part_of, lambda s: F.array_join(F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), ""))

    return F.when(F.size(spans) > 0, _bind(spans, whole)).otherwise(text)


def without(text: Column, spans: Column) -> Column:
    """The text with each of the (overlapping) spans replaced by a blank."""
    return replaced(text, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("label")))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row for each document: id, ``carry`` columns, text (null as empty), one array of spans
    (start, end, value) for each of KINDS, and generalised and removed, the spans of revealing terms."""
    names = {c: f"__carry_{i}" for i, c in enumerate(carry)}
    body = docs.select(docs[id_col].alias("__id"), *[docs[c].alias(n) for c, n in names.items()], text_of(docs, text).alias("text"))
    spans = base_spans(F.col("text"))
    hit = F.coalesce(any_hint(F.col("text")) & (F.size(F.concat(*spans.values())) > 0), F.lit(False))
    key = F.xxhash64("text")
    # the texts with found values are a small part of a corpus; only they take part in joins
    found = body.where(hit).withColumns({**spans, "key": key})
    bare = without(F.col("text"), F.concat(*KINDS))
    exposed = saved(found.select("key", hashed(entities({k: F.col(k) for k in KINDS})).alias("entities"), hashed(terms(bare)).alias("terms")).dropDuplicates(["key"]), "pii-exposed")
    others = body.where(~hit).select(key.alias("key"), "text")
    total = body.select(key.alias("key")).distinct().count()
    risk = disclosures(exposed, others, total, support, generalise, remove)
    # a text has a bounded number of terms
    by_text = saved(risk.groupBy("key").agg(F.collect_set(F.when(~F.col("removed"), F.col("term"))).alias("soft"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("hard")), "pii-texts")
    forget(exposed, risk)
    none = F.array().cast(SPANS)
    chosen = {
        name: F.when(F.size(F.coalesce(F.col(words), F.array())) > 0, _outside(matches(F.col("text"), F.lit(TERM), lambda v, w=words: F.array_contains(w, F.xxhash64(F.lower(v)))), list(KINDS))).otherwise(none)
        for name, words in (("generalised", "soft"), ("removed", "hard"))
    }
    columns = ["__id", *names.values(), "text", *KINDS, "generalised", "removed"]
    dirty = found.join(by_text, "key", "left").withColumns(chosen).select(*columns)
    clean = body.where(~hit).withColumns({k: none for k in (*KINDS, "generalised", "removed")}).select(*columns)
    out = clean.unionByName(dirty)
    return out.select(F.col("__id").alias(id_col), *[F.col(n).alias(c) for c, n in names.items()], *columns[1 + len(names) :])


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": ""}
#: Classes of generalised terms, by what the term looks like; the first that fits.
CLASSES = ((r"^\p{N}+$", "[NUMBER]"), (r"\p{N}", "[CODE]"), (r"^\p{Lu}", "[NAME]"))


def label(kind: str, value: Column) -> Column:
    """What stands for a span in the clean text."""
    if kind in LABELS:
        return F.lit(LABELS[kind])
    out = F.lit("[WORD]")
    for regex, name in reversed(CLASSES):
        out = F.when(F.rlike(value, F.lit(regex)), F.lit(name)).otherwise(out)
    return out


def masked(text: Column) -> Column:
    """The text with every span replaced by its label; of overlapping spans the first start gives the label."""

    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(kind, s["value"]).alias("label")))

    return replaced(text, F.array_sort(F.concat(*map(labelled, (*KINDS, "generalised", "removed")))))


def span_digest(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as given, then start, joined by commas."""

    def written(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(written, kinds)), ",")
