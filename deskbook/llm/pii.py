"""Personal data and the terms that give it away, in DataFrame operations only.

Patterns find e-mail addresses, IP addresses, card and phone numbers, and strings that look like keys. Each value is a
protected entity, and so is the group that it is of (mail domain, network, card issuer, phone prefix, beginning of a key)
and each of these classes. Corpus co-occurrence then estimates how strongly a word in the
documents of an entity reveals it: the pointwise mutual information of the two against the entity's own information.
Words over the disclosure thresholds are generalised or removed beside the entity itself, if their co-occurrence is more
evidence than chance gives among all the pairs that were looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, table

#: Patterns by kind, in the order in which spans are listed. Runs that already failed are not tried from their middle
#: (the look-behinds), and repeated groups give nothing back (the possessive quantifiers): same matches, linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be worth a search.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Keys and passwords: long strings with letters and digits both. Protected, but no base kind.
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>", "generalise": "<TERM>", "remove": ""}
#: Documents that a word and an entity must share before their mutual information is an estimate at all.
LEAST_DOCS = 3
#: Bits by which the evidence for a pair is to exceed the logarithm of the number of pairs: one false one in 1024 corpora.
MARGIN = 10.0
#: Pairs of entity and word that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 300_000
#: Parts of a text that are put together at once; blocks of them keep the work linear in the text's length.
BLOCK = 256
#: Shares of the entity's information from which a word is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.85, 0.95
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    backwards = F.reverse(digits)
    doubled = lambda i, d: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: doubled(i, F.substring(backwards, i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value):
    if kind == "ip":
        significant = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(significant, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).cast("int") <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _let(value, body):
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _blocks(array):
    """An array in slices of BLOCK elements; none for an empty array."""
    count = F.ceil(F.size(array) / BLOCK).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(array, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())


def _located(text, pattern: str, kind, keep):
    """Spans of a pattern's matches that ``keep`` accepts: what lies between matches tells where they stand."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast(SPAN)

    def step(acc, part):
        gap, hit = part["gap"], part["hit"]
        first = acc["at"] + F.length(gap)
        last = first + F.length(hit)
        own = F.array(F.struct(kind(hit).alias("kind"), first.alias("start"), last.alias("end"), hit.alias("value")))
        return F.struct(F.coalesce(last, first).alias("at"), F.when(hit.isNotNull() & keep(hit), F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    def block(acc, own):
        start = F.struct(acc["at"].alias("at"), none.alias("spans"))
        return F.aggregate(own, start, step, lambda done: F.struct(done["at"].alias("at"), F.concat(acc["spans"], F.array(done["spans"])).alias("spans")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return _let(parts, lambda p: F.aggregate(_blocks(p), zero, block, lambda acc: F.flatten(acc["spans"])))


def base_spans(text):
    """Array of ``{kind, start, end, value}`` of all four kinds, leftmost and non-overlapping per kind, kind by kind."""
    none = F.array().cast(SPAN)
    found = []
    for kind, pattern in PATTERNS.items():
        hinted = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        found.append(F.when(hinted, _located(text, pattern, lambda hit, kind=kind: F.lit(kind), lambda hit, kind=kind: _valid(kind, hit))).otherwise(none))
    return F.concat(*found)


def secret_spans(text):
    """Spans of strings that look like keys."""
    mixed = lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), _located(text, SECRET, lambda hit: F.lit("secret"), mixed)).otherwise(F.array().cast(SPAN))


def _entity(kind, value):
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).when(kind == "secret", value).otherwise(F.lower(value)))


def _group(kind, value):
    """What a value shares with others of its kind: who runs the mailbox, network, card or line, or who issued the key."""
    return (
        F.when(kind == "email", F.concat(F.lit("domain:"), F.lower(F.substring_index(value, "@", -1))))
        .when(kind == "ip", F.concat(F.lit("network:"), F.substring_index(value, ".", 3)))
        .when(kind == "card", F.concat(F.lit("issuer:"), F.substring(_digits(value), 1, 6)))
        .when(kind == "phone", F.concat(F.lit("prefix:"), F.substring(_digits(value), 1, 5)))
        .otherwise(F.concat(F.lit("begins:"), F.substring(value, 1, 4)))
    )


def _entities(spans):
    """The protected values of a text's spans, their groups and their classes."""
    kinds = (lambda s: _entity(s["kind"], s["value"]), lambda s: _group(s["kind"], s["value"]), lambda s: F.concat(F.lit("any "), s["kind"]))
    return F.array_distinct(F.concat(*(F.transform(spans, of) for of in kinds)))


def _terms(text):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))


def _outside_terms():
    """Words of ``text`` outside the spans in ``private``."""
    return _terms(_replaced(F.col("text"), _in_order(F.col("private")), lambda kind: F.lit(" ")))


def marked(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``private`` (base spans and secrets), located once and written to the shared folder.

    ``texts`` false: texts of rows without private spans, which nothing reads again, are left out.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.drop("base", "terms", "private").withColumn("base", base_spans(text)).withColumn("private", F.concat("base", F.filter(secret_spans(text), lambda s: ~_meets(s, F.col("base")))))
    return cut(found if texts else found.withColumn("text", F.when(F.size("private") > 0, F.col("text"))), "marked")


def _meets(span, others):
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def disclosing_terms(private: DataFrame, corpus: DataFrame, least: int = LEAST_DOCS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``text, private`` of documents with entities, ``text`` of all documents -> ``entity, term, action`` for words that
    reveal an entity.

    A word reveals an entity if the pointwise mutual information of the two over whole documents reaches the given share
    of the entity's information. Both must share ``least`` documents, and the evidence (these documents times the
    information in bits) must exceed the logarithm of the number of such pairs by MARGIN, so that none of the many pairs
    of rare words gets there by chance. All counts are rows of the table, copies among them; group-bys are pre-aggregated,
    so an entity or word in a third of all rows is no hot key, and classes and large groups meet their documents' words
    where these lie (``attach``); words inside an entity don't count, neither beside it nor as the corpus's; only entities
    of so many documents meet their documents' words, and the corpus's words are counted before they meet the candidates.
    """
    n_docs = corpus.count()
    near = cut(private.select(_outside_terms().alias("terms"), _entities(F.col("private")).alias("entities")), "outside-terms")
    common = cut(near.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"), F.count("*").alias("heat")).where(F.col("n_entity") >= least), "entities")
    met = attach(near.select("terms", F.explode("entities").alias("entity")), common, ["entity"], "heat", near.agg(F.sum(F.size("entities"))).first()[0] or 0).where("n_entity is not null")
    pairs = met.select("entity", "n_entity", F.explode("terms").alias("term"))
    counted = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"))
    candidates = cut(counted.where(F.col("n_both") >= least), "terms")
    enough = math.log2(max(1, candidates.count())) + MARGIN
    every = corpus.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    inside = private.select(F.explode(F.array_except(_terms(F.col("text")), _outside_terms())).alias("term")).groupBy("term").agg((-F.count("*")).alias("n"))  # in no place but spans
    spread = every.unionByName(inside).groupBy("term").agg(F.sum("n").alias("n_term")).where(F.col("n_term") >= least)
    information = F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    shared = F.log2(F.lit(float(n_docs)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    judged = candidates.join(spread, "term").where((information > 0) & (shared >= generalise * information) & (F.col("n_both") * shared >= enough))
    return judged.select("entity", "term", F.when(shared >= remove * information, "remove").otherwise("generalise").alias("action"))


def find_pii(docs: DataFrame, texts: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``terms``: arrays of ``{kind, start, end, value}`` in code points.

    ``base`` holds the patterns' spans kind by kind; ``terms`` the secrets (kind ``secret``) and the words that reveal one
    of the row's own entities (kind ``generalise`` or ``remove``), outside base spans, by place. Rows without entities take
    no part in any shuffle of texts. Null text counts as empty and has no spans; repeated rows are judged alike; an empty
    table gives no rows; columns named base, terms and private are replaced. ``texts`` false: texts of rows without
    entities are null in the result.
    """
    found = marked(docs, texts)
    private = F.size("private") > 0
    narrow = found.where(private).select("text", "private")
    terms = cut(disclosing_terms(narrow, docs), "disclosing")
    distinct = narrow.groupBy(F.md5("text").alias("text_key_"), "text").agg(F.count("*").alias("rows_"), F.first("private").alias("private"))
    own = distinct.select("text_key_", "rows_", _entities(F.col("private")).alias("entities"), _outside_terms().alias("words")).select("text_key_", "rows_", "words", F.explode("entities").alias("entity"))
    own = own.select("text_key_", "rows_", "entity", F.explode("words").alias("term"))  # a text meets its own words alone
    flagged = F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms
    per_word = own.join(flagged, ["entity", "term"]).groupBy("text_key_", "rows_", "term").agg(F.max("action").alias("action"))  # the stronger one
    actions = cut(per_word.groupBy("text_key_", "rows_").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions")), "actions")
    none = F.array().cast(SPAN)
    plain = found.where(~private).withColumn("terms", none)
    touched = attach(found.where(private).withColumn("text_key_", F.md5("text")), actions, ["text_key_"], "rows_", narrow.count())
    lookup = lambda hit: F.element_at(F.col("actions"), F.lower(hit))
    words = _located(F.col("text"), r"\p{L}+", lookup, lambda hit: lookup(hit).isNotNull())
    outside = F.filter(words, lambda w: ~_meets(w, F.col("private")))
    secrets = F.filter("private", lambda s: s["kind"] == "secret")
    by_place = F.array_sort(F.concat(secrets, F.when(F.col("actions").isNotNull(), outside).otherwise(none)), lambda x, y: x["start"] - y["start"])
    return plain.unionByName(touched.withColumn("terms", by_place).drop("text_key_", "actions")).drop("private")


def _in_order(spans):
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _replaced(text, spans, mark):
    """``text`` with the spans (by start) replaced by ``mark`` of their kinds; of overlapping ones the first."""
    behind = lambda rest, n: F.substring(rest, n + 1, F.length(rest))

    def step(acc, s):
        ahead = s["start"] >= acc["at"]
        out = F.when(ahead, F.concat(acc["out"], F.substring(acc["rest"], F.lit(1), s["start"] - acc["at"]), mark(s["kind"]))).otherwise(acc["out"])
        end = F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), behind(acc["rest"], end - acc["at"]).alias("rest"), out.alias("out"))

    def block(acc, own):
        end = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))
        start = F.struct(acc["at"].alias("at"), F.substring(acc["rest"], F.lit(1), end - acc["at"]).alias("rest"), F.lit("").alias("out"))
        done = F.aggregate(own, start, step, lambda a: a["out"])
        return F.struct(end.alias("at"), behind(acc["rest"], end - acc["at"]).alias("rest"), F.concat(acc["out"], F.array(done)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return _let(spans, lambda p: F.aggregate(_blocks(p), zero, block, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"])))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities, secrets and disclosing words replaced by their placeholders; ``n_chars``, if there, follows.

    All rows and columns stay (columns named base, terms or private too); rows without entities keep their text, null included; cases as in ``find_pii``.
    """
    named = {c: f"{c}_kept_" for c in docs.columns if c in ("base", "terms", "private")}
    found = find_pii(docs.withColumnsRenamed(named))
    placeholder = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    spans = _in_order(F.concat("base", "terms"))
    touched = F.size("base") + F.size("terms") > 0
    made = found.withColumn("text", F.when(touched, _replaced(F.col("text"), spans, lambda kind: placeholder[kind])).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return made.drop("base", "terms").withColumnsRenamed({v: k for k, v in named.items()}).select(docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in all of ``documents``, with ``n_spans``, the number of all; cases as in ``find_pii``."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", "terms")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
