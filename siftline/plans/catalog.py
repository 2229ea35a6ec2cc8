"""Every registered query of the engine with its DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import rows as R
from siftline.functions import scalars as X
from siftline.functions import text as T
from siftline.operators import generations as G
from siftline.operators import percolate as P
from siftline.operators import suggest as S
from siftline.plans import instances as I
from siftline.plans.compiler import Plan, Scorer, within
from siftline.plans.nodes import And, AndNot, AtLeast, Const, Leaf, Maybe, Node, Or, Phrase, Term, parse
from siftline.plans.rewrite import Alternative, from_rules, rewrite
from siftline.sources.collection import Collection, Documents, Masks
from siftline.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_TOKS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
D = f"d AS (SELECT doc_id, lang, source, {_TOKS.format('text')} AS t FROM documents)"
H = f"{D}, h AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM d)"
PQ = f"{H}, p AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS freq FROM h GROUP BY term, doc_id)"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


def add(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def has(term: str) -> str:
    return f"SELECT doc_id FROM h WHERE term = '{term}'"


def phrase_sql(*terms: str, what: str = "DISTINCT a.doc_id") -> str:
    joins = "".join(f" JOIN h x{k} ON x{k}.doc_id = a.doc_id AND x{k}.pos = a.pos + {k} AND x{k}.term = '{t}'" for k, t in enumerate(terms) if k)
    return f"SELECT {what} FROM h a{joins} WHERE a.term = '{terms[0]}'"


def ids(name: str, query: str | Node, sql: str) -> None:
    """A query whose result is the matching ids; ``sql`` may use ``h``."""
    node = parse(query) if isinstance(query, str) else query

    @add(name, f"WITH {H} {sql}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return Plan.over(node, docs(spark, sf)).ids()


ids("term_docs", "the", "SELECT DISTINCT doc_id FROM h WHERE term = 'the'")
ids("term_unknown", "zzzunknownzzz", "SELECT DISTINCT doc_id FROM h WHERE term = 'zzzunknownzzz'")
ids("and_terms", "the of", f"{has('the')} INTERSECT {has('of')}")
ids("and_many", "the of that is", f"{has('the')} INTERSECT {has('of')} INTERSECT {has('that')} INTERSECT {has('is')}")
ids("or_terms", "que OR der OR les", f"{has('que')} UNION {has('der')} UNION {has('les')}")
ids("and_not", "(the of) NOT was", f"({has('the')} INTERSECT {has('of')}) EXCEPT {has('was')}")
ids("not_complement", "NOT the", f"SELECT DISTINCT doc_id FROM documents EXCEPT {has('the')}")
ids("optional_terms", "<the>", "SELECT DISTINCT doc_id FROM h WHERE term = 'the'")
ids("min_match_2of4", "MINMATCH(2, the, que, der, is)", "SELECT doc_id FROM h WHERE term IN ('the', 'que', 'der', 'is') GROUP BY doc_id HAVING count(DISTINCT term) >= 2")
ids("min_match_edges", Or((AtLeast(3, (Term("the"), Term("of"), Term("is"))), AtLeast(1, (Term("que"), Term("und"))))), f"({has('the')} INTERSECT {has('of')} INTERSECT {has('is')}) UNION {has('que')} UNION {has('und')}")
ids("phrase2", '"of the"', phrase_sql("of", "the"))
ids("phrase3", '"the of the"', phrase_sql("the", "of", "the"))
ids("any_phrases", '"of the" OR "que la" OR "of that"', f"{phrase_sql('of', 'the')} UNION {phrase_sql('que', 'la')} UNION {phrase_sql('of', 'that')}")
ids("all_phrases", '"of the" "the of"', f"{phrase_sql('of', 'the')} INTERSECT {phrase_sql('the', 'of')}")
ids("nested_bool", '(("of the") OR (is AND was)) NOT les', f"(({phrase_sql('of', 'the')}) UNION ({has('is')} INTERSECT {has('was')})) EXCEPT {has('les')}")


ids("unary_and", And((Term("the"),)), "SELECT DISTINCT doc_id FROM h WHERE term = 'the'")
ids("const_true", And((Const(True), Maybe(Term("the")))), "SELECT doc_id FROM documents")
ids("const_false", Or((Const(False), And((Term("the"), Const(False))), Term("of"))), "SELECT DISTINCT doc_id FROM h WHERE term = 'of'")
ids("subsumed", AndNot(And((Phrase(("of", "the")), Term("of"), Or((Phrase(("the", "of")), Term("is"))))), Phrase(("was", "the"))), f"({phrase_sql('of', 'the')} INTERSECT ({phrase_sql('the', 'of')} UNION {has('is')})) EXCEPT {phrase_sql('was', 'the')}")


@add("word_space", f"WITH {H} {phrase_sql('of', 'the', what='a.doc_id, a.pos')}")
def word_space(spark, sf):
    found = T.hits(docs(spark, sf), ["of", "the"])
    starts = T.word_space(found).select("doc_id", "space", F.explode(F.map_keys("space")).alias("pos"))
    return starts.where(T.stands_at(F.col("space"), F.col("pos"), ["of", "the"])).select("doc_id", F.col("pos").cast("long").alias("pos"))


@add("plan_explain", """SELECT * FROM (VALUES (0, 'read 5 terms from rows of documents, positions of of, the'), (1, '  first without second'), (2, '    any of'), (3, '      phrase "of the"'), (4, '      all of'), (5, '        term is'), (6, '        optional'), (7, '          term was'), (8, '    term les')) v(line, text)""")
def plan_explain(spark, sf):
    lines = Plan.over(parse('("of the" OR (is <was>)) NOT les'), docs(spark, sf)).explain().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


@add("optional_left", f"WITH {PQ} SELECT a.doc_id, a.freq AS of_freq, coalesce(b.freq, 0) AS the_freq FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id AND b.term = 'the' WHERE a.term = 'of'")
def optional_left(spark, sf):
    node = parse("of <the>")
    plan = Plan.over(node, docs(spark, sf))
    return plan.table().where(plan.match(plan.node)).select("doc_id", plan.count(Term("of")).alias("of_freq"), F.coalesce(plan.count(Term("the")), F.lit(0)).alias("the_freq"))


@add("phrase_count", f"WITH {H} {phrase_sql('of', 'the', what='a.doc_id, CAST(count(*) AS INTEGER) AS n')} GROUP BY a.doc_id")
def phrase_count(spark, sf):
    node = Phrase(("of", "the"))
    plan = Plan.over(node, docs(spark, sf))
    return plan.table().select("doc_id", plan.count(node).alias("n")).where("n > 0")


@add("range_span", f"WITH {H} SELECT DISTINCT doc_id FROM h WHERE term = 'the' AND doc_id >= 100 AND doc_id < 100000")
def range_span(spark, sf):
    return Plan.over(Term("the"), within(docs(spark, sf), 100, 100000)).ids()


@add("id_list", f"WITH {H} {has('the')} INTERSECT SELECT unnest([1, 2, 3, 5, 8, 13, 21, 34, 55, 89])")
def id_list(spark, sf):
    node = And((Term("the"), Leaf("ids")))
    listed = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)], "doc_id long")
    return Plan.over(node, docs(spark, sf), {"ids": listed}).ids()


@add("app_docset", f"WITH {H} {has('of')} EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def app_docset(spark, sf):
    node = AndNot(Term("of"), Leaf("toxic"))
    return Plan.over(node, docs(spark, sf), {"toxic": read(spark, sf, "labels").where("toxic = 1")}).ids()


@add("doc_filter", f"WITH {H} SELECT DISTINCT h.doc_id FROM h JOIN documents USING (doc_id) WHERE term = 'the' AND lang = 'en' AND n_chars < 2000")
def doc_filter(spark, sf):
    return Plan.over(Term("the"), docs(spark, sf), where="lang = 'en' and n_chars < 2000").ids()


@add("special_token", f"WITH {H} {has('la')} INTERSECT SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'")
def special_token(spark, sf):
    d, node = docs(spark, sf), parse("la (lang:fr OR src:src3)")
    found = T.hits(d, ["la"]).unionByName(T.specials(d))
    return Plan(node, T.postings(found, False)).ids()


@add("term_freq", f"WITH {PQ} SELECT term, doc_id, freq FROM p")
def term_freq(spark, sf):
    return T.postings(T.hits(docs(spark, sf)), False)


@add("doc_freq", f"WITH {PQ} SELECT term, count(*) AS df FROM p GROUP BY term")
def doc_freq(spark, sf):
    return T.postings(T.hits(docs(spark, sf)), False).groupBy("term").agg(F.count("*").alias("df"))


@add("field_stats", f"WITH {PQ} SELECT CAST(sum(freq) AS BIGINT) AS sum_term_hits, count(DISTINCT term) AS total_terms, count(*) AS sum_terms_docs, count(DISTINCT doc_id) AS docs_cnt FROM p")
def field_stats(spark, sf):
    return T.field_stats(T.postings(T.hits(docs(spark, sf)), False))


@add("doc_field_stats", f"""WITH {PQ}, s AS (SELECT doc_id, count(*) AS terms, max(freq) AS max_freq, CAST(sum(freq) AS BIGINT) AS hits FROM p GROUP BY doc_id)
SELECT doc_id, terms + CAST(lang IS NOT NULL AS INTEGER) + CAST(source IS NOT NULL AS INTEGER) AS terms, CAST(max_freq AS BIGINT) AS max_freq, hits + CAST(lang IS NOT NULL AS INTEGER) + CAST(source IS NOT NULL AS INTEGER) AS hits, hits AS positional_hits, CAST(0 AS BIGINT) AS overlaps FROM s JOIN d USING (doc_id)""")
def doc_field_stats(spark, sf):
    d = docs(spark, sf)
    return R.doc_stats(d, T.special_terms()).where("positional_hits > 0")


@add("terms_dict", f"WITH {PQ} SELECT term, count(*) AS df, CAST(sum(freq) AS BIGINT) AS cf FROM p GROUP BY term")
def terms_dict(spark, sf):
    return T.postings(T.hits(docs(spark, sf)), False).groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("cf"))


def weight(kind: str, df: str) -> str:
    n = "(SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) FROM p)"
    if kind == "tfidf":
        return f"(ln(({n} + 1) / ({df} + 1)) + 1)"
    return f"ln(1 + ({n} - {df} + CAST(0.5 AS DOUBLE)) / ({df} + CAST(0.5 AS DOUBLE)))"


def df_of(term: str) -> str:
    return f"(SELECT CAST(count(*) AS DOUBLE) FROM p WHERE term = '{term}')"


def leaf_sql(kind: str, term: str) -> str:
    f = "CAST(freq AS DOUBLE)"
    value = {"trivial": f, "tfidf": f"sqrt({f}) * {weight('tfidf', df_of(term))}", "bm25": f"{weight('bm25', df_of(term))} * ({f} / ({f} + CAST(1.2 AS DOUBLE)))"}[kind]
    return f"SELECT doc_id, {value} AS s FROM p WHERE term = '{term}'"


def scored(name: str, query: str, kind: str, sql: str) -> None:
    node = parse(query)

    @add(name, f"WITH {PQ} {sql}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return Plan.over(node, docs(spark, sf)).scored(kind).select("doc_id", F.round("score", 6).alias("score"))


_SUM = "SELECT doc_id, round(sum(s), 6) AS score FROM ({}) GROUP BY doc_id"
scored("score_trivial", "the OR of", "trivial", _SUM.format(f"{leaf_sql('trivial', 'the')} UNION ALL {leaf_sql('trivial', 'of')}"))
scored("score_tfidf", "the of", "tfidf", _SUM.format(f"{leaf_sql('tfidf', 'the')} UNION ALL {leaf_sql('tfidf', 'of')}") + " HAVING count(*) = 2")
_OR3 = " UNION ALL ".join(leaf_sql("bm25", t) for t in ("the", "of", "that"))
scored("score_bm25", "the OR of OR that", "bm25", _SUM.format(_OR3))
scored("score_nested", "(the NOT was) OR (of is)", "bm25", f""", a AS ({leaf_sql('bm25', 'the')}), b AS ({leaf_sql('bm25', 'of')} UNION ALL {leaf_sql('bm25', 'is')})
 SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'was')
 UNION ALL SELECT doc_id, sum(s) FROM b GROUP BY doc_id HAVING count(*) = 2) GROUP BY doc_id""")
_PHRASE = phrase_sql("of", "the", what="a.doc_id, CAST(count(*) AS DOUBLE) AS n")
scored("score_phrase", '"of the"', "bm25", f"SELECT doc_id, round(({weight('bm25', df_of('of'))} + {weight('bm25', df_of('the'))}) * (n / (n + CAST(1.2 AS DOUBLE))), 6) AS score FROM ({_PHRASE} GROUP BY a.doc_id)")


@add("topk_bm25", f"WITH {PQ} SELECT doc_id, round(sum(s), 6) AS score FROM ({_OR3}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def topk_bm25(spark, sf):
    return QUERIES["score_bm25"](spark, sf).orderBy(F.desc("score"), "doc_id").limit(10)


@add("rich_match", f"WITH {PQ}, ps AS (SELECT doc_id, term, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM h WHERE term IN ('of', 'the') GROUP BY doc_id, term) SELECT doc_id, term, freq, positions FROM p JOIN ps USING (doc_id, term) WHERE doc_id IN (({has('of')} INTERSECT {has('the')}) EXCEPT {has('was')})")
def rich_match(spark, sf):
    node = parse("(of the) NOT was")
    rich = Plan.over(node, docs(spark, sf)).rich()
    return rich.withColumn("positions", F.concat_ws(",", F.col("positions").cast("array<string>")))


_SLOTTED = '(world of "warcraft mists") OR (of of pandaria) NOT spam'


@add("query_index_terms", "SELECT * FROM (VALUES (0, 'world', 1, 0), (1, 'of', 1, 0), (2, 'warcraft', 1, 0), (3, 'mists', 1, 0), (4, 'of', 1, 0), (5, 'pandaria', 0, 0)) v(slot, term, to_next_span, flags)")
def query_index_terms(spark, sf):
    return I.index_terms(I.table(spark, I.instances(_SLOTTED)))


@add("rich_instances", f"WITH {PQ}, i AS (SELECT * FROM (VALUES ('of', '0:1:1:0,2:1:1:1'), ('the', '1:1:1:0,3:1:0:1')) v(term, instances)) SELECT doc_id, term, freq, instances FROM p JOIN i USING (term) WHERE doc_id IN (({phrase_sql('of', 'the')}) EXCEPT {has('was')})")
def rich_instances(spark, sf):
    query = '((of the) "of the") NOT was'
    rich = I.annotated(Plan.over(parse(query), docs(spark, sf)).rich(), I.table(spark, I.instances(query)))
    each = F.transform("instances", lambda i: F.concat_ws(":", i["slot"], i["rep"], i["to_next_span"], i["phrase_id"]))
    return rich.select("doc_id", "term", "freq", F.concat_ws(",", each).alias("instances"))


@add("matches_counter", f"WITH {H} SELECT doc_id, count(DISTINCT term) AS matched FROM h WHERE term IN ('the', 'of', 'que') GROUP BY doc_id")
def matches_counter(spark, sf):
    return Plan.over(parse("the OR of OR que"), docs(spark, sf)).counted().select("doc_id", F.col("matched").cast("long").alias("matched"))


@add("payload_hits", f"WITH {H} SELECT doc_id, CAST(count(*) AS INTEGER) AS freq, CAST(sum(pos * 3) AS BIGINT) AS total FROM h WHERE term = 'the' GROUP BY doc_id")
def payload_hits(spark, sf):
    """Each hit has three times its position as a payload of four bytes."""
    found = T.postings(T.hits(docs(spark, sf), ["the"], payload=lambda t, p: T.fixed(p * 3, 4)))
    total = F.aggregate("payloads", F.lit(0).cast("long"), lambda a, x: a + T.number(x))
    return found.select("doc_id", "freq", total.alias("total"))


@add("own_tokenizer", "WITH h AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS term FROM documents) SELECT doc_id, CAST(count(*) AS INTEGER) AS freq FROM h WHERE term = 'The' GROUP BY doc_id")
def own_tokenizer(spark, sf):
    """Words between white space as they are written."""
    plan = Plan.over(Term("The"), docs(spark, sf), tokenize=lambda text: F.split(text, "[ \\t\\n\\r]+"))
    return plan.table().where(plan.match(plan.node)).select("doc_id", plan.count(Term("The")).alias("freq"))


@add("own_scorer", f"WITH {PQ} SELECT doc_id, round(sum(2 * sqrt(CAST(freq AS DOUBLE))), 6) AS score FROM p WHERE term IN ('the', 'of') GROUP BY doc_id")
def own_scorer(spark, sf):
    twice = Scorer(lambda f, w: F.sqrt(f.cast("double")) * w, lambda n, df: F.lit(2.0))
    return Plan.over(parse("the OR of"), docs(spark, sf)).scored(twice).select("doc_id", F.round("score", 6).alias("score"))


@add("leaf_scores", f"WITH {PQ} SELECT doc_id, CAST(freq AS DOUBLE) AS score FROM p WHERE term = 'of' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def leaf_scores(spark, sf):
    """The application's own set filters and scores nothing."""
    good = read(spark, sf, "labels").where("quality = 1")
    return Plan.over(And((Term("of"), Leaf("good"))), docs(spark, sf), {"good": good}).scored("trivial")


@add("wrapped_scores", f"WITH {PQ} SELECT doc_id, CAST(sum(CASE WHEN term = 'the' THEN 3 * freq ELSE freq END) AS DOUBLE) AS score FROM p WHERE term IN ('the', 'of') GROUP BY doc_id")
def wrapped_scores(spark, sf):
    return Plan.over(parse("the OR of"), docs(spark, sf)).scored("trivial", wrap=lambda node, score: score * 3 if node == Term("the") else score)


@add("collection_search", f"WITH {H} ({has('the')} EXCEPT SELECT doc_id FROM labels WHERE toxic = 1) UNION SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 0 AND toxic = 0 AND text IS NOT NULL")
def collection_search(spark, sf):
    """All documents, revisions of those of low quality that begin with 'the', and erasure of the toxic ones."""
    d, labels = docs(spark, sf), read(spark, sf, "labels")
    revised = d.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("the "), "text"))
    return Collection({1: Documents(d), 2: Documents(revised, replacing=True), 3: Masks(labels.where("toxic = 1"))}).plan("the").ids()


_GENS = f"""WITH d1 AS (SELECT doc_id, text, 1 AS gen FROM documents), d2 AS (SELECT doc_id, concat('revised ', text) AS text, 2 AS gen FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
 u AS (SELECT doc_id, 2 AS gen FROM d2 UNION ALL SELECT doc_id, 3 FROM labels WHERE toxic = 1), ug AS (SELECT doc_id, max(gen) AS ug FROM u GROUP BY doc_id),
 a AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2), w AS (SELECT doc_id, gen, unnest({_TOKS.format('text')}) AS term FROM a),
 p AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS freq, CAST(gen AS BIGINT) AS gen FROM w GROUP BY ALL), live AS (SELECT p.* FROM p LEFT JOIN ug USING (doc_id) WHERE ug IS NULL OR gen >= ug)"""


def gens(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Three generations: all documents, revisions of those of low quality, and erasure of the toxic ones."""
    d, labels = docs(spark, sf), read(spark, sf, "labels")
    revised = d.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("revised "), "text"))
    part = lambda x, g: T.postings(T.hits(x), False).withColumn("gen", F.lit(g).cast("long"))
    updates = revised.select("doc_id", F.lit(2).cast("long").alias("gen")).unionByName(labels.where("toxic = 1").select("doc_id", F.lit(3).cast("long").alias("gen")))
    return part(d, 1).unionByName(part(revised, 2)), updates


@add("multi_gen_live", f"{_GENS} SELECT term, doc_id, freq, gen FROM live")
def multi_gen_live(spark, sf):
    return G.live(*gens(spark, sf)).select("term", "doc_id", "freq", "gen")


@add("merge_segments", f"{_GENS} SELECT term, doc_id, freq, CAST(4 AS BIGINT) AS gen FROM live")
def merge_segments(spark, sf):
    return G.merged(*gens(spark, sf), gen=4).select("term", "doc_id", "freq", "gen")


@add("erase_docs", f"WITH {H} {has('the')} EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def erase_docs(spark, sf):
    p = T.postings(T.hits(docs(spark, sf), ["the"]), False).withColumn("gen", F.lit(1))
    return G.live(p, read(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(2).alias("gen"))).select("doc_id")


@add("replace_docs", f"{_GENS} SELECT doc_id FROM live WHERE term = 'revised'")
def replace_docs(spark, sf):
    return G.live(*gens(spark, sf)).where("term = 'revised'").select("doc_id")


@add("mask_only_source", f"WITH {H} SELECT DISTINCT doc_id FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def mask_only_source(spark, sf):
    p = docs(spark, sf).where(F.size(T.tokens(F.col("text"))) > 0).select("doc_id", F.lit(1).alias("gen"))
    return G.live(p, read(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(2).alias("gen"))).select("doc_id").distinct()


@add("retention", "SELECT * FROM (VALUES (1, 'delete'), (2, 'retain_all'), (3, 'retain_updates'), (4, 'retain_updates'), (5, 'retain_all')) v(gen, decision)")
def retention(spark, sf):
    return G.retention(spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, False)], "gen int, candidate boolean"))


@add("dup_guard", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id HAVING count(*) > 1")
def dup_guard(spark, sf):
    return G.duplicates(docs(spark, sf).select("doc_id").unionByName(read(spark, sf, "labels").where("quality = 0").select("doc_id")))


@add("docid_translate", f"WITH {PQ} SELECT term, doc_id + 1000000 AS doc_id, freq FROM p WHERE term = 'the'")
def docid_translate(spark, sf):
    d = docs(spark, sf)
    return G.translated(T.postings(T.hits(d, ["the"]), False), d.select(F.col("doc_id").alias("local_id"), (F.col("doc_id") + 1000000).alias("global_id")).distinct())


def shared(spark: SparkSession) -> str:
    """A folder of its own under the session's checkpoint folder; a temporary one only within this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siftline-")
    return f"{root}/siftline-{uuid.uuid4().hex}"


_STORES: dict[tuple[str, str, str], Store] = {}


def stored(spark: SparkSession, sf: str, kind: str = "one") -> Store:
    """An index of the documents, built once a session: of ``one`` generation, of the ``three`` of ``gens``, or these ``compacted``."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _STORES:
        if kind == "compacted":
            _STORES[key] = stored(spark, sf, "three").compact(4, shared(spark))
            return _STORES[key]
        store, d, labels = Store(spark, shared(spark)), docs(spark, sf), read(spark, sf, "labels")
        store.commit(1, added=d)
        if kind == "three":
            poor = labels.where("quality = 0").select("doc_id").distinct()
            revised = d.join(F.broadcast(poor) if poor.count() <= G.FEW else poor, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("revised "), "text"))
            store.commit(2, replaced=revised)
            store.commit(3, erased=labels.where("toxic = 1").select("doc_id"))
        _STORES[key] = store
    return _STORES[key]


@add("store_search", f"WITH {H} (({phrase_sql('of', 'the')}) UNION ({has('is')} INTERSECT {has('was')})) EXCEPT {has('les')}")
def store_search(spark, sf):
    return stored(spark, sf).plan('(("of the") OR (is AND was)) NOT les').ids()


@add("store_complement", f"WITH {H} SELECT DISTINCT doc_id FROM documents EXCEPT {has('the')}")
def store_complement(spark, sf):
    return stored(spark, sf).plan("NOT the").ids()


@add("store_scored", f"WITH {PQ} {_SUM.format(_OR3)}")
def store_scored(spark, sf):
    return stored(spark, sf).plan("the OR of OR that").scored("bm25").select("doc_id", F.round("score", 6).alias("score"))


@add("store_terms", f"WITH {PQ} SELECT term, count(*) AS df, CAST(sum(freq) AS BIGINT) AS cf FROM p GROUP BY term")
def store_terms(spark, sf):
    return stored(spark, sf).terms(raw=True)


@add("store_lookup", f"WITH {PQ} SELECT term, count(*) AS df, CAST(sum(freq) AS BIGINT) AS cf FROM p WHERE term = 'the' GROUP BY term")
def store_lookup(spark, sf):
    return stored(spark, sf).lookup("the")


@add("store_live", f"{_GENS} SELECT term, doc_id, freq, gen FROM live")
def store_live(spark, sf):
    return stored(spark, sf, "three").postings().select("term", "doc_id", "freq", "gen")


@add("store_updates", f"{_GENS} SELECT DISTINCT doc_id, CAST(gen AS BIGINT) AS gen FROM u")
def store_updates(spark, sf):
    return stored(spark, sf, "three").updates()


@add("store_stats_raw", f"{_GENS}, g AS (SELECT gen, CAST(sum(freq) AS BIGINT) AS a, count(DISTINCT term) AS b, count(*) AS c, count(DISTINCT doc_id) AS d FROM p GROUP BY gen) SELECT CAST(sum(a) AS BIGINT) AS sum_term_hits, CAST(sum(b) AS BIGINT) AS total_terms, CAST(sum(c) AS BIGINT) AS sum_terms_docs, CAST(sum(d) AS BIGINT) AS docs_cnt FROM g")
def store_stats_raw(spark, sf):
    """Added up over generations, with what later ones replaced or erased."""
    return stored(spark, sf, "three").stats()


@add("store_phrase_live", f"{_GENS}, w2 AS (SELECT doc_id, gen, t[i] AS a, t[i + 1] AS b FROM (SELECT doc_id, gen, {_TOKS.format('text')} AS t FROM a), unnest(range(1, len(t))) r(i)) SELECT DISTINCT doc_id FROM w2 LEFT JOIN ug USING (doc_id) WHERE (ug IS NULL OR gen >= ug) AND a = 'revised' AND b = 'the'")
def store_phrase_live(spark, sf):
    return stored(spark, sf, "three").plan('"revised the"').ids()


@add("stream_index", f"WITH {PQ} SELECT doc_id, freq FROM p WHERE term = 'the'")
def stream_index(spark, sf):
    """The documents as a stream, each micro-batch a generation of an index."""
    from siftline.streaming.percolator import index_stream

    base = shared(spark)
    store = Store(spark, f"{base}/index")
    stream = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{sf}/documents.parque?")
    index_stream(stream, store, f"{base}/state").awaitTermination()
    return store.postings().where("term = 'the'").select("doc_id", "freq")


@add("store_after_compact", f"{_GENS} SELECT doc_id, freq FROM live WHERE term = 'revised'")
def store_after_compact(spark, sf):
    return stored(spark, sf, "compacted").postings().where("term = 'revised'").select("doc_id", "freq")


_SLOTS = ("the", "of", "was", "que", "der")
_MASK = "+".join(f"max(CASE WHEN term = '{t}' THEN {1 << k} ELSE 0 END)" for k, t in enumerate(_SLOTS))
_MASKS = f"WITH {H}, o AS (SELECT doc_id, CAST({_MASK} AS BIGINT) AS mask FROM h WHERE term IN {_SLOTS} GROUP BY doc_id), m AS (SELECT mask, count(*) AS cnt FROM o GROUP BY mask)"
_MAXIMAL = "SELECT mask, cnt FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.mask <> a.mask AND (a.mask & b.mask) = a.mask)"


def slot_postings(spark: SparkSession, sf: str) -> DataFrame:
    return T.postings(T.hits(docs(spark, sf), _SLOTS), False)


@add("coverage_masks", f"{_MASKS} SELECT mask, cnt FROM m")
def coverage_masks(spark, sf):
    return S.masks(slot_postings(spark, sf), _SLOTS)


@add("maximal_masks", f"{_MASKS} {_MAXIMAL.format('m')}")
def maximal_masks(spark, sf):
    return S.maximal(S.masks(slot_postings(spark, sf), _SLOTS))


_NAMES = ", ".join(f"CASE WHEN (mask & {1 << k}) <> 0 THEN '{t}' END" for k, t in enumerate(_SLOTS))


@add("alternatives_top5", f"{_MASKS}, n AS (SELECT * FROM m WHERE mask <> 31), x AS ({_MAXIMAL.format('n')}) SELECT mask, cnt, concat_ws(' ', {_NAMES}) AS terms FROM x ORDER BY bit_count(mask) DESC, cnt DESC, mask LIMIT 5")
def alternatives_top5(spark, sf):
    return S.alternatives(slot_postings(spark, sf), _SLOTS)


def rewritten(name: str, query: str, rules: dict[tuple[str, ...], list[str]], sql: str) -> None:
    ids(name, rewrite(parse(query), from_rules(rules)), sql)


@add("masks_united", f"{_MASKS} SELECT mask, CAST(cnt AS BIGINT) AS cnt FROM m")
def masks_united(spark, sf):
    """Masks of English texts and of all others, added up."""
    d = docs(spark, sf)
    part = lambda where: S.masks(T.postings(T.hits(d.where(where), _SLOTS), False), _SLOTS)
    return S.united([part("lang = 'en'"), part("coalesce(lang, '') <> 'en'")])


@add("mask_bits", f"{_MASKS} SELECT mask, k AS bit FROM m, unnest(range(5)) r(k) WHERE (mask & (1 << k)) <> 0")
def mask_bits(spark, sf):
    return S.masks(slot_postings(spark, sf), _SLOTS).select("mask", F.explode(S.bits(F.col("mask"))).alias("bit")).withColumn("bit", F.col("bit").cast("long"))


@add("rewrite_trace", "SELECT * FROM (VALUES (0, 2, 'ofthe', 4, CAST(0.5 AS DOUBLE), 2), (0, 1, 'from', 0, CAST(1 AS DOUBLE), 1), (2, 3, 'que', 0, CAST(1 AS DOUBLE), 1)) v(first, stop, text, flags, coefficient, source_size)")
def rewrite_trace(spark, sf):
    rules = {("of", "the"): [Alternative("ofthe", flags=4, coefficient=0.5)], ("of",): ["from"], ("is",): ["que"], ("the",): []}
    trace: list = []
    rewrite(parse("of the is"), from_rules(rules), trace=trace)
    rows = [(p.start, p.stop, p.text, p.flags, p.coefficient, p.source_size) for p in trace]
    return spark.createDataFrame(rows, "first int, stop int, text string, flags int, coefficient double, source_size int")


ids("rewrite_budget", rewrite(parse("the was"), from_rules({("was",): ["is", "of"], ("the",): ["les"]}), budget=1), f"{has('the')} INTERSECT ({has('was')} UNION {has('is')})")


@add("alternatives_detail", f"{_MASKS}, n AS (SELECT * FROM m WHERE mask <> 31), x AS ({_MAXIMAL.format('n')}) SELECT mask, cnt, concat_ws('+', {_NAMES}) AS tokens, CAST(list_min([k FOR k IN range(5) IF (mask & (1 << k)) <> 0]) AS INTEGER) AS first_bit FROM x ORDER BY bit_count(mask) DESC, cnt DESC, mask LIMIT 5")
def alternatives_detail(spark, sf):
    node = parse(" ".join(_SLOTS))
    return S.sub_queries(node, slot_postings(spark, sf)).select("mask", "cnt", F.concat_ws("+", "tokens").alias("tokens"), "first_bit")


rewritten("rewrite_synonyms", "the was", {("was",): ["is", "of"]}, f"{has('the')} INTERSECT ({has('was')} UNION {has('is')} UNION {has('of')})")
rewritten("rewrite_segmentation", "of the is", {("of", "the"): ['"of the"', "that"], ("is",): ["que"]}, f"(({has('of')} INTERSECT {has('the')}) UNION {phrase_sql('of', 'the')} UNION {has('that')}) INTERSECT ({has('is')} UNION {has('que')})")

_STORED = {1: "the NOT was", 2: '"of the"', 3: "que OR der OR les", 4: "MINMATCH(2, is, was, that)", 5: "<the>"}
_STORED_SQL = f"""WITH {H} SELECT doc_id, CAST(1 AS BIGINT) AS query_id FROM ({has('the')} EXCEPT {has('was')}) UNION ALL SELECT doc_id, 2 FROM ({phrase_sql('of', 'the')})
 UNION ALL SELECT doc_id, 3 FROM (SELECT DISTINCT doc_id FROM h WHERE term IN ('que', 'der', 'les'))
 UNION ALL SELECT doc_id, 4 FROM (SELECT doc_id FROM h WHERE term IN ('is', 'was', 'that') GROUP BY doc_id HAVING count(DISTINCT term) >= 2) UNION ALL SELECT doc_id, 5 FROM documents WHERE text IS NOT NULL"""


@add("percolate_terms", _STORED_SQL)
def percolate_terms(spark, sf):
    return P.percolate(docs(spark, sf), {k: parse(q) for k, q in _STORED.items()})


@add("percolate_phrases", f"WITH {D}, q AS (SELECT item_id AS query_id, {_TOKS.format('text')} AS t FROM benchmark) SELECT doc_id, query_id FROM d JOIN q ON contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(q.t, ' ') || ' ')")
def percolate_phrases(spark, sf):
    return P.percolate_phrases(docs(spark, sf), read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


_MANY = """SELECT n * 3 AS query_id, w AS one, NULL AS two FROM v UNION ALL SELECT n * 3 + 1, w, nxt FROM v WHERE nxt IS NOT NULL UNION ALL SELECT n * 3 + 2, w, NULL FROM v"""


@add("percolate_many", f"""WITH {H}, o AS (SELECT DISTINCT term FROM h WHERE length(term) >= 4), v AS (SELECT term AS w, row_number() OVER (ORDER BY term) - 1 AS n, lead(term) OVER (ORDER BY term) AS nxt FROM o QUALIFY n < 400),
 q AS ({_MANY}), k AS (SELECT DISTINCT doc_id, term FROM h)
SELECT DISTINCT k.doc_id, q.query_id FROM q JOIN k ON k.term = q.one WHERE query_id % 3 = 0 UNION ALL
SELECT k.doc_id, q.query_id FROM q JOIN k ON k.term = q.one JOIN k l ON l.doc_id = k.doc_id AND l.term = q.two WHERE query_id % 3 = 1 UNION ALL
SELECT k.doc_id, q.query_id FROM q JOIN k ON k.term = q.one WHERE query_id % 3 = 2 AND k.doc_id NOT IN (SELECT doc_id FROM h WHERE term = 'the')""")
def percolate_many(spark, sf):
    """1200 stored queries as a table: for each of the first 400 words of four letters or more the word, it with the next one, and it without 'the'."""
    d = docs(spark, sf)
    found = d.select(F.explode(T.tokens(F.col("text"))).alias("w")).where("length(w) >= 4").distinct().orderBy("w").limit(401)
    words = [r.w for r in found.collect()]  # of a fixed number
    rows = [(3 * k + j, q) for k, w in enumerate(words[:400]) for j, q in enumerate((w, f"{w} {words[k + 1]}" if k + 1 < len(words) else None, f"{w} NOT the")) if q]
    return P.percolate_table(d, spark.createDataFrame(rows, "query_id long, query string"))


@add("percolate_stream", _STORED_SQL)
def percolate_stream(spark, sf):
    from siftline.streaming.percolator import percolate_stream as stream

    base = shared(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return stream(spark, f"{sf}/documents.parque?", schema, {k: parse(q) for k, q in _STORED.items()}, f"{base}/out", f"{base}/state")


@add("scalar_text", f"WITH {PQ} SELECT DISTINCT term, starts_with(term, 'th') AS starts, length(term) AS n_chars, substring(term, 1, 3) AS head, CAST(bit_count(length(term)) AS INTEGER) AS bits, regexp_full_match(term, '[0-9]+') AS digits, base64(encode(term)) AS coded FROM p")
def scalar_text(spark, sf):
    t = T.hits(docs(spark, sf)).select("term").distinct()
    return t.select("term", F.startswith("term", F.lit("th")).alias("starts"), F.length("term").cast("long").alias("n_chars"), F.substring("term", 1, 3).alias("head"), F.bit_count(F.length("term")).cast("int").alias("bits"), F.col("term").rlike("^[0-9]+$").alias("digits"), F.base64(F.encode("term", "UTF-8")).alias("coded"))


@add("scalar_more", f"""WITH {H}, t AS (SELECT DISTINCT term FROM h) SELECT term, ends_with(term, 'ing') AS ends, CAST(instr(term, 'e') - 1 AS INTEGER) AS first_e, CASE WHEN contains(term, 'e') THEN string_split(term, 'e')[1] ELSE term END AS head,
 CAST(len(string_split(term, 'e')) AS INTEGER) AS parts, rtrim(term, 's') AS bare, CASE WHEN regexp_full_match(term, '[0-9]{{1,9}}') THEN CAST(term AS DECIMAL(38, 0)) < 4294967296 END AS small,
 CASE WHEN starts_with(term, 'th') THEN substring(term, 3) ELSE term END AS cut, format('{{:,}}', length(term) * 1234567) AS dotted, strftime(make_timestamp(CAST(length(term) AS BIGINT) * 100000000000), '%Y-%m-%d %H:%M:%S') AS at FROM t""")
def scalar_more(spark, sf):
    t, term = T.hits(docs(spark, sf)).select("term").distinct(), F.col("term")
    small = F.when(term.rlike("^[0-9]{1,9}$"), X.as_unsigned(term).isNotNull())
    return t.select(
        "term", X.ends_with(term, "ing").alias("ends"), X.search(term, "e").alias("first_e"), X.prefix_up_to(term, "e").alias("head"), F.size(X.split(term, "e")).alias("parts"), X.strip_trailing(term, "s").alias("bare"), small.alias("small"),
        X.strip_prefix(term, "th").alias("cut"), X.dotted(F.length(term) * 1234567).alias("dotted"), X.time_repr(F.length(term) * 100000).alias("at"),
    )
