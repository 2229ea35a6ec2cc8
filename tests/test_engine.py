import random
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from siftline.functions import scalars as X  # noqa: E402
from siftline.functions.text import field_stats, fixed, hits, number, postings, specials  # noqa: E402
from siftline.operators.control import abort, abortable  # noqa: E402
from siftline.operators.generations import retention  # noqa: E402
from siftline.operators.percolate import clauses, percolate, percolate_phrases, percolate_table  # noqa: E402
from siftline.operators.suggest import alternatives, masks  # noqa: E402
from siftline.plans.compiler import SCORERS, Plan  # noqa: E402
from siftline.plans.instances import Instance, index_terms, instances, rewritten, table  # noqa: E402
from siftline.plans.nodes import FALSE, And, AndNot, AtLeast, Const, Leaf, Maybe, Not, Or, Phrase, QueryError, Term, matches, parse, settled, simplify  # noqa: E402
from siftline.plans.rewrite import Alternative, from_rules, rewrite  # noqa: E402
from siftline.sources.collection import Collection, Documents, Listed, Masks, Source  # noqa: E402
from siftline.sources.store import Store  # noqa: E402

CORPUS = {1: "world of warcraft mists of pandaria", 2: "mists of world warcraft", 3: "pizza onions san francisco", 4: "pizza sf", 5: "san jose francisco pizza", 6: "star wars return of the jedi", 7: "wars jedi star", 8: "the food of the world"}
CASES = {
    "of world": [1, 2, 8], "sf OR francisco": [3, 4, 5], "pizza NOT onions": [4, 5], 'pizza (sf OR "san francisco")': [3, 4], '(pizza (sf OR "san francisco")) NOT onions': [4], '"san francisco"': [3], '"world of warcraft"': [1],
    '"of the"': [6, 8], "<the> of": [1, 2, 6, 8], "MINMATCH(2, star, wars, the)": [6, 7], "NOT of": [3, 4, 5, 7], "pizza -onions": [4, 5], "missing": [], "(missing NOT of) OR sf": [4],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(CORPUS.items()), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def posted(docs):
    return postings(hits(docs)).cache()


@pytest.mark.parametrize("query", CASES)
def test_ids(docs, posted, query):
    assert sorted(r.doc_id for r in Plan(parse(query), posted, docs).ids().collect()) == CASES[query]
    assert [d for d, t in CORPUS.items() if matches(parse(query), t.split())] == CASES[query]


def test_scores(posted):
    got = lambda q, s: {r.doc_id: round(r.score, 6) for r in Plan(parse(q), posted).scored(s).collect()}
    assert got("of", "tfidf") == {1: 2.245469, 2: 1.587787, 6: 1.587787, 8: 1.587787}
    assert got("of OR the", "bm25") == {1: 0.433217, 2: 0.315067, 6: 0.897310, 8: 1.115651}
    assert got('"san francisco"', "bm25") == {3: 1.164485}
    assert got("of", "trivial") == {1: 2, 2: 1, 6: 1, 8: 1}


def test_statistics(posted):
    assert tuple(field_stats(posted).first()) == (34, 17, 32, 8)


def test_masks(posted):
    assert {(r.mask, r.cnt) for r in masks(posted, ["pizza", "san", "francisco", "sf"]).collect()} == {(7, 2), (9, 1)}
    assert [(r.mask, r.cnt, r.terms) for r in alternatives(posted, ["star", "wars", "return", "jedi"]).collect()] == [(11, 1, "star wars jedi")]


def test_generations(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.commit(1, added=docs)
    store.commit(2, replaced=spark.createDataFrame([(4, "pizza san francisco")], "doc_id long, text string"), erased=spark.createDataFrame([(7,)], "doc_id long"))
    store.commit(3, erased=spark.createDataFrame([(3,)], "doc_id long"))
    for view in (store, store.compact(4, str(tmp_path / "merged"))):
        p = view.postings()
        assert sorted(r.doc_id for r in p.select("doc_id").distinct().collect()) == [1, 2, 4, 5, 6, 8]
        assert [r.doc_id for r in Plan(parse('"san francisco"'), p).ids().collect()] == [4]
        assert [r.doc_id for r in Plan(parse("wars"), p).ids().collect()] == [6]
    with pytest.raises(ValueError):
        store.commit(5, added=docs.unionByName(docs))
    kept = retention(spark.createDataFrame([(1, True), (2, False), (3, True)], "gen int, candidate boolean"))
    assert {tuple(r) for r in kept.collect()} == {(1, "delete"), (2, "retain_all"), (3, "retain_updates")}


def test_percolation(spark, docs):
    stored = {1: parse("pizza NOT sf"), 2: parse('"of the"'), 3: parse("<zzz>")}
    assert {tuple(r) for r in percolate(docs, stored).where(F.col("query_id") < 3).collect()} == {(3, 1), (5, 1), (6, 2), (8, 2)}
    assert percolate(docs, stored).where("query_id = 3").count() == len(CORPUS)
    phrases = spark.createDataFrame([(1, "san francisco"), (2, "of world"), (3, "world of warcraft mists"), (4, ""), (5, "sf")], "query_id long, text string")
    assert {tuple(r) for r in percolate_phrases(docs, phrases).collect()} == {(3, 1), (2, 2), (1, 3), (4, 5)}


def test_simplify():
    a, b, c = Term("a"), Term("b"), Term("c")
    assert simplify(And((AndNot(a, b), b))) == FALSE
    assert simplify(AndNot(AndNot(b, a), b)) == FALSE
    assert simplify(AtLeast(2, (a, b))) == And((a, b))
    assert simplify(AtLeast(1, (a, b))) == Or((a, b))
    assert simplify(Or((Maybe(a), b))) == Or((a, b))
    assert simplify(And((a, And((b, c)), a))) == And((a, b, c))
    for bad in ("(a", "a )", "OR", "MINMATCH(1, a"):
        with pytest.raises(QueryError):
            parse(bad)


def test_rewrite():
    rules = {("mac", "book"): ["macbook"], ("ps4",): ["playstation 4"], ("world", "of", "warcraft"): ["wow"]}
    go = lambda q, **k: rewrite(parse(q), from_rules(rules), **k)
    assert matches(go("mac book"), ["macbook"]) and matches(go("mac book"), ["mac", "book"]) and not matches(go("mac book"), ["mac"])
    assert matches(go("new ps4"), ["new", "playstation", "4"]) and not matches(go("new ps4"), ["playstation", "4"])
    assert matches(go("world of warcraft game"), ["wow", "game"])
    assert go("mac book", budget=0) == And((Term("mac"), Term("book")))


WORDS = ["a", "b", "c", "d"]
TREES = st.recursive(
    st.sampled_from(WORDS).map(Term) | st.lists(st.sampled_from(WORDS), min_size=2, max_size=3).map(lambda w: Phrase(tuple(w))) | st.booleans().map(Const),
    lambda t: st.lists(t, min_size=1, max_size=3).map(lambda p: And(tuple(p))) | st.lists(t, min_size=1, max_size=3).map(lambda p: Or(tuple(p))) | t.map(Maybe)
    | st.tuples(t, t).map(lambda p: AndNot(*p)) | t.map(Not) | st.tuples(st.integers(0, 3), st.lists(t, min_size=1, max_size=3)).map(lambda p: AtLeast(p[0], tuple(p[1]))),
    max_leaves=6,
)


@given(TREES, st.lists(st.lists(st.sampled_from(WORDS), max_size=5), min_size=1, max_size=6))
@settings(max_examples=500, deadline=None)
def test_simplified_trees_mean_the_same(tree, texts):
    own = clauses(tree)
    for t in texts:
        assert matches(tree, t) == matches(simplify(tree), t)
        assert matches(tree, t, percolating=True) == matches(simplify(settled(tree)), t)
        if own is not None:
            line = f" {' '.join(t)} "
            holds = lambda n: n.text in t if isinstance(n, Term) else f" {' '.join(n.terms)} " in line
            assert matches(tree, t, percolating=True) == any(all(map(holds, need)) and not any(map(holds, no)) for need, no in own)


def random_trees(n, seed=3):
    r = random.Random(seed)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice([Term(r.choice(WORDS)), Phrase(tuple(r.choice(WORDS) for _ in range(r.randint(2, 3)))), Const(r.random() < 0.5)])
        some = lambda k: tuple(tree(depth - 1) for _ in range(k))
        return r.choice([lambda: And(some(r.randint(1, 3))), lambda: Or(some(r.randint(1, 3))), lambda: Not(tree(depth - 1)), lambda: AndNot(*some(2)), lambda: Maybe(tree(depth - 1)), lambda: AtLeast(r.randint(0, 3), some(3))])()

    return [tree(3) for _ in range(n)]


def test_plans_mean_what_trees_do(spark):
    """Spark plans over rows, over postings and of percolation against the plain definition."""
    r = random.Random(5)
    texts = {k: [r.choice(WORDS) for _ in range(r.randint(0, 5))] for k in range(25)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string").coalesce(1).cache()
    found = postings(hits(docs)).coalesce(1).cache()
    trees = random_trees(24)
    for n in trees[:14]:
        want = sorted(k for k, t in texts.items() if matches(n, t))
        assert sorted(x.doc_id for x in Plan.over(n, docs).ids().collect()) == want, n
        assert sorted(x.doc_id for x in Plan(n, found, docs).ids().collect()) == want, n
    want = {(k, q) for q, n in enumerate(trees) for k, t in texts.items() if matches(n, t, percolating=True)}
    assert {tuple(x) for x in percolate(docs, dict(enumerate(trees))).collect()} == want


def test_percolation_by_tables(spark, docs, monkeypatch):
    stored = {k: q for k, q in enumerate([*CASES, "<the> NOT star", "star OR <zzz>", "MINMATCH(0, a)", '("of the" NOT jedi) OR "pizza sf"'])}
    want = {(d, k) for k, q in stored.items() for d, t in CORPUS.items() if matches(parse(q), t.split(), percolating=True)}
    queries = spark.createDataFrame(list(stored.items()), "query_id long, query string")
    assert {tuple(x) for x in percolate_table(docs, queries).collect()} == want
    assert percolate_table(docs, queries.limit(0)).collect() == [] and percolate_table(docs.limit(0), queries).collect() == []
    for name, value in (("EXPRESSIONS", 2), ("BROADCAST", 0)):
        monkeypatch.setattr("siftline.operators.percolate." + name, value)
        assert {tuple(x) for x in percolate(docs, {k: parse(q) for k, q in stored.items()}).collect()} == want
        assert {tuple(x) for x in percolate_table(docs, queries).collect()} == want


def test_rows_and_postings_score_alike(spark, docs, posted):
    for query in ("of OR the", '"of the" OR pizza', "of <world> NOT jedi", "MINMATCH(2, star, wars, the)", "NOT of", " ".join(CORPUS[1].split()) + " OR star"):
        for scorer in SCORERS:
            rows = {x.doc_id: round(x.score, 9) for x in Plan.over(parse(query), docs).scored(scorer).collect()}
            assert rows == {x.doc_id: round(x.score, 9) for x in Plan(parse(query), posted, docs).scored(scorer).collect()}, query
        rich = lambda p: {(x.doc_id, x.term, x.freq, tuple(x.positions)) for x in p.rich().collect()}
        if query != "NOT of":
            assert rich(Plan.over(parse(query), docs)) == rich(Plan(parse(query), posted, docs))
    many = Or(tuple(Term(f"w{k}") for k in range(100)) + (Phrase(("of", "the")),))
    assert sorted(x.doc_id for x in Plan.over(many, docs).ids().collect()) == [6, 8]
    assert {x.doc_id for x in Plan.over(many, docs).scored().collect()} == {6, 8}
    assert 'phrase "of the"' in Plan.over(many, docs).explain() and "live documents" in Plan.over(parse("NOT of"), docs).explain()


def test_phrases_of_other_tokenizers(spark):
    docs = spark.createDataFrame([(1, "New  York,a a,a a,a a"), (2, "york,new"), (3, None), (4, "a a,a a")], "doc_id long, text string")
    split = lambda text: F.split(text, ",")
    plan = Plan.over(Phrase(("a a", "a a")), docs, tokenize=split)
    assert {tuple(x) for x in plan.scored("trivial").collect()} == {(1, 2.0), (4, 1.0)}
    assert sorted(x.doc_id for x in Plan.over(Or((Phrase(("New  York", "a a")), Not(Term("york")))), docs, tokenize=split).ids().collect()) == [1, 3, 4]
    assert {tuple(x) for x in Plan.over(Phrase(("a", "a")), docs).scored("trivial").collect()} == {(1, 5.0), (4, 3.0)}


def test_plans_are_built_without_jobs(spark, docs, posted, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.commit(1, added=docs)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans")
    Plan.over(parse('"of the" OR star'), docs).scored()
    Plan(parse("of NOT star"), posted, docs).scored()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup("building")


def test_store_statistics_and_visibility(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    assert store.generations() == [] and store.postings().collect() == [] and store.plan("of").ids().collect() == []
    store.commit(1, added=docs)
    assert tuple(store.stats().first()) == (34, 17, 32, 8)
    assert [tuple(x) for x in store.lookup("of").collect()] == [("of", 4, 5)] and store.lookup("zzz").collect() == []
    got = {x.doc_id: round(x.score, 6) for x in store.plan("of OR the").scored("bm25").collect()}
    assert got == {1: 0.433217, 2: 0.315067, 6: 0.897310, 8: 1.115651}
    assert sorted(x.doc_id for x in store.plan("NOT of").ids().collect()) == [3, 4, 5, 7]
    # a generation without its mark isn't seen
    store._write_postings(postings(hits(spark.createDataFrame([(99, "of")], "doc_id long, text string"))), 2)
    assert 99 not in {x.doc_id for x in store.plan("of").ids().collect()}
    store.commit(2, replaced=spark.createDataFrame([(4, "of all")], "doc_id long, text string"), erased=spark.createDataFrame([(1,)], "doc_id long"))
    assert sorted(x.doc_id for x in store.keep().plan("of").ids().collect()) == [2, 4, 6, 8]
    store.release()
    assert store.lookup("of").first().df == 5  # as scores count, with what was erased
    plan = store.plan("of").table()._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,of)" in plan.replace("In(term, [of])", "EqualTo(term,of)")


def test_store_merges_in_place(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    new = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string")
    store.commit(1, added=docs)
    store.commit(2, replaced=new(4, "pizza york"))
    store.commit(3, replaced=new(9, "pizza rome"), erased=spark.createDataFrame([(5,)], "doc_id long"))
    store.commit(4, replaced=new(9, "pizza pisa"))
    live = lambda: {tuple(x) for x in store.postings().select("term", "doc_id", "freq").collect()}
    before = live()
    rule = {x.gen: x.decision for x in store.merge([2, 3], 3).collect()}
    assert rule == {1: "retain_all", 2: "retain_updates", 3: "retain_updates", 4: "retain_all"}
    assert store.generations() == [1, 3, 4] and live() == before
    store.merge([1, 3, 4], 4)
    assert store.generations() == [4] and live() == before and store.updates().collect() == []
    assert store.stats().first().docs_cnt == 8 == store.documents().count()
    with pytest.raises(ValueError):
        store.merge([9], 9)


def test_collections(spark, docs):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "doc_id long")
    revised = Documents(spark.createDataFrame([(7, "stars")], "doc_id long, text string"), replacing=True)
    local = Documents(spark.createDataFrame([(1, "of mars")], "doc_id long, text string"), idmap=spark.createDataFrame([(1, 101)], "local_id long, global_id long"))
    both = Collection({1: Documents(docs), 2: revised, 3: Masks(ids(1)), 4: local})
    assert all(isinstance(s, Source) for s in (*both.sources.values(), both, Listed(spark, [1])))
    assert sorted(x.doc_id for x in both.plan("of").ids().collect()) == [2, 6, 8, 101]
    assert sorted(x.doc_id for x in both.plan("wars OR stars").ids().collect()) == [6, 7]
    assert sorted(x.doc_id for x in both.plan("NOT of").ids().collect()) == [3, 4, 5, 7]
    node = And((Term("of"), Leaf("mine")))
    assert [x.doc_id for x in Plan(node, both.postings(), named={"mine": Listed(spark, [8, 9]).documents()}).ids().collect()] == [8]


def test_streams_index_and_replace(spark, tmp_path):
    from siftline.streaming.percolator import index_stream

    store = Store(spark, str(tmp_path / "index"))
    schema = "doc_id long, text string, at long"
    for part, rows in enumerate([[(1, "old star", 1), (2, "war", 1), (1, "new star", 2)], [(2, "peace", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_stream(stream, store, str(tmp_path / "state"), order="at").awaitTermination()
        assert len(store.generations()) == part + 1
    assert {(x.term, x.doc_id) for x in store.postings().collect()} == {("new", 1), ("star", 1), ("peace", 2)}


def test_instances():
    got = instances("world of of warcraft \"mists of pandaria\" NOT (a b)")
    assert [(i.slot, i.term, i.rep, i.to_next_span, i.phrase_id) for i in got] == [(0, "world", 1, 1, 0), (1, "of", 2, 1, 0), (2, "warcraft", 1, 1, 0), (3, "mists", 1, 1, 1), (4, "of", 1, 1, 1), (5, "pandaria", 1, 0, 1)]
    trace = []
    rewrite(parse("mac book pro"), from_rules({("mac", "book"): [Alternative("macbook", flags=4, coefficient=0.5)], ("pro",): ["professional"]}), trace=trace)
    made = {(i.slot, i.term, i.to_next_span, i.flags, i.first, i.stop, i.coefficient, i.source_size) for i in rewritten(["mac", "book", "pro"], trace)}
    assert {(0, "macbook", 2, 4, 0, 2, 0.5, 2), (2, "professional", 0, 0, 2, 3, 1.0, 1), (0, "mac", 1, 0, 0, 1, 1.0, 1)} <= made


def test_index_terms(spark):
    found = table(spark, [Instance(0, "a", flags=1), Instance(0, "a", flags=2), Instance(1, "b")])
    assert index_terms(found).count() == 3 and index_terms(found, disregard_flags=True).count() == 2


def test_payloads(spark, docs):
    found = postings(hits(docs, ["of"], payload=lambda t, p: fixed(p * 1000)).unionByName(specials(docs.selectExpr("doc_id", "'en' as lang", "null as source"), payload=F.lit("x"))))
    got = {(x.term, x.doc_id): (list(x.positions), [None if b is None else bytes(b) for b in x.payloads]) for x in found.collect()}
    assert got["of", 1] == ([2, 5], [(2000).to_bytes(8, "little"), (5000).to_bytes(8, "little")]) and got["lang:en", 3] == ([0], [b"x"])
    assert [x.n for x in spark.range(1).select(F.explode(F.array(*[number(fixed(F.lit(k))) for k in (0, 1, 255, 65536, 2**40)])).alias("n")).collect()] == [0, 1, 255, 65536, 2**40]


def test_signs_and_numbers_in_queries():
    assert parse("salt & pepper") == And((Term("salt"), Term("pepper"))) and parse("&") == FALSE == parse("") and parse("a NOT &") == Term("a") and parse("(&) OR b") == Term("b")
    for bad in ("MINMATCH(x, a)", "(", "a OR", "NOT"):
        with pytest.raises(QueryError):
            parse(bad)


def test_subsumption():
    a, b = Term("a"), Term("b")
    long, short = Phrase(("a", "b", "c")), Phrase(("a", "b"))
    assert simplify(And((short, long))) == long and simplify(AndNot(long, b)) == FALSE and simplify(AndNot(Or((long, Term("x"))), b)) == AndNot(Term("x"), b)
    assert simplify(And((Const(True), Maybe(a)))) == And((Const(True), Maybe(a))) and simplify(AndNot(And((a, b)), b)) == FALSE and simplify(Maybe(a)) == a


def test_scalars(spark):
    row = spark.createDataFrame([("hello.world.x", 1536, 12, "  ", "4294967296", 0)], "t string, n long, m int, b string, u string, z long").select(
        X.common_prefix(F.col("t"), F.lit("help")), X.suffix_from(F.col("t"), "."), X.search_last(F.col("t"), "."), X.divided(F.col("t"), ".")["after"], F.size(X.split(F.col("t"), ".")), X.is_blank(F.col("b")), X.as_unsigned(F.col("u")), X.as_unsigned(F.col("u"), 64).cast("long"),
        X.size_repr(F.col("n")), X.to_base(F.col("m"), 2), X.from_base(F.lit("ff"), 16), X.lowest_bit(F.col("m").cast("long")), X.lowest_bit(F.col("z")), X.as_double(F.lit("1.5e1")), X.as_double(F.lit("x")), X.intersection(F.lit(1), F.lit(5), F.lit(3), F.lit(9))["stop"], X.overlaps(F.lit(1), F.lit(2), F.lit(2), F.lit(3)),
    ).first()
    assert list(row) == [3, "world.x", 11, "world.x", 3, True, None, 4294967296, "1.50kb", "1100", 255, 2, -1, 15.0, None, 5, False]


def test_abort(spark):
    import threading
    import time

    failed = []

    def slow(frames):
        time.sleep(40)
        yield from frames

    def run():
        with abortable(spark, "mine"):
            try:
                spark.range(4).repartition(4).selectExpr("java_method('java.lang.Thread', 'sleep', cast(60000 as bigint)) as x").collect()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    from pyspark import InheritableThread

    t = InheritableThread(target=run)
    start = time.time()
    t.start()
    while not failed and time.time() - start < 25:
        time.sleep(1)
        abort(spark, "mine")
    t.join(60)
    assert failed and time.time() - start < 38


def test_registry_without_the_llm_folders():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "topk_bm25" in names and set(entry.oracle_sql()) <= set(names)


ODD = [(1, "a b a"), (2, None), (3, ""), (4, "... --"), (-5, "Éa b é z"), (6, "b " * 300 + "a"), (None, "a q")]


@pytest.mark.parametrize("at_once, file", [(1 << 20, 1_000_000), (4, 20)])
def test_index_of_rows_is_that_of_hits(spark, tmp_path, monkeypatch, at_once, file):
    from siftline.functions import rows

    monkeypatch.setattr(rows, "FILE", file)
    monkeypatch.setattr(rows, "GUESS_OF", 1)
    docs = spark.createDataFrame([*ODD, *((k, f"a w{k} b") for k in range(20, 50))], "doc_id long, text string")
    want = sorted(map(str, postings(hits(docs)).select("term", "doc_id", "freq", "positions").collect()))
    starts = rows.bounds(docs, docs.count())
    assert (len(starts) > 2) == (file == 20)
    monkeypatch.setattr(rows, "AT_ONCE", at_once)
    parts = [list(b) for b in rows.postings(docs, starts).rdd.mapPartitions(lambda x: [list(x)]).collect()]
    got = [r for p in parts for r in p]
    assert sorted(map(str, got)) == want
    last = [(r.term.encode(), float("inf") if r.doc_id is None else r.doc_id) for p in parts for r in p]
    for p in parts:
        own = [(r.term.encode(), float("inf") if r.doc_id is None else r.doc_id) for r in p]
        assert own == sorted(own) and (file == 20 or own == last)
    if file == 20:
        store = Store(spark, str(tmp_path / "index"))
        store.commit(1, added=docs)
        assert tuple(store.stats().first()) == tuple(field_stats(postings(hits(docs))).first())


def test_an_index_is_built_without_shuffling_hits(spark, docs):
    from siftline.functions import rows

    plan = rows.postings(docs, []).selectExpr("term")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Sort " not in plan


@pytest.mark.parametrize("few", [0, 1000])
def test_hidden_ids_are_broadcast_while_few(spark, docs, tmp_path, monkeypatch, few):
    from siftline.sources import store as S

    monkeypatch.setattr(S, "FEW", few)
    store = Store(spark, str(tmp_path / "index"))
    store.commit(1, added=docs)
    store.commit(2, replaced=spark.createDataFrame([(4, "pizza york")], "doc_id long, text string"), erased=spark.createDataFrame([(7,), (7,)], "doc_id long"))
    assert ("ResolvedHint (strategy=broadcast)" in store.postings()._jdf.queryExecution().analyzed().toString()) == (few > 0)
    assert sorted(x.doc_id for x in store.plan("pizza OR star").ids().collect()) == [3, 4, 5, 6]
    merged = store.compact(3, str(tmp_path / "merged"))
    assert sorted(map(str, merged.postings().select("term", "doc_id", "positions").collect())) == sorted(map(str, store.postings().select("term", "doc_id", "positions").collect()))
    assert merged.stats().first().docs_cnt == 7 == merged.documents().count()


def test_doc_stats_of_rows_are_those_of_hits(spark, monkeypatch):
    from siftline.functions import rows
    from siftline.functions.text import doc_stats, special_terms

    docs = spark.createDataFrame([(*r, *x) for r, x in zip(ODD[:6], [("en", "s"), ("en", None), (None, None), ("fr", "s"), (None, "s"), ("en", "t")])], "doc_id long, text string, lang string, source string")
    want = doc_stats(hits(docs).unionByName(specials(docs)))
    for at_once in (1 << 20, 3):
        monkeypatch.setattr(rows, "AT_ONCE", at_once)
        got = rows.doc_stats(docs, special_terms())
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 1000])
def test_batches_with_ids_that_come_again(spark, tmp_path, monkeypatch, few):
    from siftline.streaming import percolator

    monkeypatch.setattr(percolator, "FEW", few)
    store, schema = Store(spark, str(tmp_path / "index")), "doc_id long, text string, at long"
    spark.createDataFrame([(1, "new", 2), (1, "old", 1), (2, "war", 1), (None, "x", 1), (None, "y", 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    percolator.index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "state"), order="at").awaitTermination()
    assert {(x.term, x.doc_id) for x in store.postings().collect()} == {("new", 1), ("war", 2), ("x", None)}
