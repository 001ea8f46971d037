"""Text functions, tiers, gates and owners on written cases; the whole engine against plain Python rules."""
import pytest
from pyspark.sql import functions as F

from sparlink.functions import similarity as S
from sparlink.functions import text as X
from sparlink.operators import audit, blocking, graph, metrics, resolve, scoring
from sparlink.operators.prepare import prepare
from sparlink.plans import resolution
from sparlink.plans.profiles import EXACT, PROFILES, V2, V6
from sparlink.sources import entities as E


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [
    ("Café & Co. [id: 12]", "cafe and co"), ("foo.co.uk", "foo uk"), ("me@shop.com", "me shop"), (None, ""), ("  ", ""), ("id: 77 Straße", "strae"), ("Ａcme ñandú", "cme nandu")])
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize, raw) == want


def test_normalize_exact_folds_all(spark):
    assert one(spark, lambda c: X.normalize(c, exact=True), "Ａcme ﬁne ½") == "acme fine 12"


def test_text_cases(spark):
    assert one(spark, lambda c: X.core_name(c), "llc inc") == "llc inc" and one(spark, X.sorted_key, "llc inc") == ""
    assert one(spark, X.alias_parts, "north star dba blue moon") == ["north star", "blue moon"] and one(spark, X.alias_parts, "north star") == []
    assert one(spark, X.phone_tokens, "suite 100 75001") == ["10075001"]
    assert one(spark, X.phone_tokens, "+1 (555) 010-9999") == ["15550109999", "155501099"]
    assert one(spark, X.country_code, "United States") == "us" and one(spark, X.country_code, " Peru ") == "pe" and one(spark, X.country_code, None) == ""
    assert one(spark, X.first_postal, "12 main road 75001") == "75001"
    assert one(spark, lambda c: X.house_number(c, X.first_postal(c)), "75001 12b main") == "12b"
    assert one(spark, X.distinctive_address, "12 main zeta road apple zeta") == ["apple", "zeta"]
    assert one(spark, X.soundex_code, "ashcraft") == "A226" and one(spark, X.soundex_code, "Robert") == "R163" and one(spark, X.soundex_code, "a1") == ""
    assert one(spark, lambda c: X.category_mask(c), "hotel bank inn") == 4 | 16
    assert one(spark, X.char_grams, "ab") == ["ab"] and one(spark, X.char_grams, "") == [] and one(spark, X.padded_grams, "a") == [" a", "a ", " a "]
    assert one(spark, X.domain_token, "https://www.blue-moon.co.uk/x") == "bluemoon"


@pytest.mark.parametrize(("kernel", "a", "b", "want"), [
    ("ratio", "kitten", "sitting", 8 / 13), ("ratio", "", "a", 0), ("token_sort", "b a", "a b", 1), ("token_set", "apex", "apex trading", 1), ("partial", "apex", "the apex trading", 1),
    ("weighted", "apex", "apex trading", 0.9), ("jaro_winkler", "martha", "marhta", 0.9611111), ("jaro_winkler", "dwayne", "duane", 0.84), ("token_set", "a b", "c d", 1 / 3)])
def test_kernels(kernel, a, b, want):
    assert S.KERNELS[kernel](a, b) == pytest.approx(want, abs=1e-6)


def test_lcs_is_exact():
    import random

    random.seed(2)
    for _ in range(200):
        a, b = ("".join(random.choice("abc ") for _ in range(random.randint(0, 80))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        assert S.lcs_length(a, b) == row[-1]
        for k in ("ratio", "token_sort", "token_set", "weighted", "partial"):
            assert 0 <= S.KERNELS[k](a, b) <= 1 + 1e-9
        assert S.ratio(a, b) == pytest.approx(S.ratio(b, a))


def entities(spark, rows):
    return prepare(spark.createDataFrame([(i, n, a, c, k) for k, (i, n, a, c) in enumerate(rows)], "entity_id string, name string, address string, country string, ord long"))


def test_tiers(spark):
    q = entities(spark, [("S1-1", "Blue Moon Trading LLC", "12 High Street Springfield 75001", "US")])
    cases = {
        "S2-core": ("Blue Moon Trading Inc", "12 High Street Springfield 75001", "US", 0.95), "S2-sorted": ("Trading Moon Blue", "12 High Street Springfield 75001", "US", 0.92),
        "S2-alias": ("Zeta dba Blue Moon Trading", "12 High Street Springfield 75001", "US", 0.94), "S2-concat": ("Bluemoontrading", "12 High Street Springfield 75001", "US", 0.90),
        "S2-country": ("Blue Moon Trading", "12 High Street Springfield 75001", "India", None), "S2-address": ("Blue Moon Trading", "99 Other Avenue Shelbyville 10001", "US", None),
        "S2-fuzzy": ("Blue Moon Tradng", "12 High Street Springfield 75001", "US", 0.87), "S2-blank": ("Blue Moon Trading", "", "US", 0.95)}
    t = entities(spark, [(k, *v[:3]) for k, v in cases.items()])
    pairs = q.select(F.col("entity_id").alias("s1_id")).join(t.select(F.col("entity_id").alias("target_id")))
    got = {r.target_id: r.score for r in scoring.score_pairs(pairs, q, t, V6).collect()}
    assert got == {k: v[3] for k, v in cases.items() if v[3]}


def test_captured_branch_stays_at_zero(spark):
    """A non-ASCII name with an equal number but a weak address takes no later tier, but the edit tier still applies."""
    q = entities(spark, [("S1-1", "日本 abcd", "12 zeta alpha", "")])
    t = entities(spark, [("S2-1", "日本 abce", "12 zeta omega", "")])
    pairs = q.select(F.col("entity_id").alias("s1_id")).join(t.select(F.col("entity_id").alias("target_id")))
    p = scoring.evidence(scoring.with_records(pairs, q, t)).withColumn("s_non_ascii", F.lit(True))
    tier = scoring.fuzzy_tier(V2, F.lit(0.95), F.lit(0.5))
    assert p.select(tier.alias("x")).first().x == 0.83
    assert p.withColumn("s_core", F.lit("abcdefghij")).select(tier.alias("x")).first().x == 0.0


def scored(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, target_id string, score double, a_sim double, pm boolean, nm boolean, s_ord long, t_blank boolean, core_len int")


def test_owners_and_gates(spark):
    df = scored(spark, [("a", "t1", 0.95, 0.5, False, False, 2, False, 9), ("b", "t1", 0.95, 0.5, False, False, 1, False, 9), ("c", "t1", 0.95, 0.5, False, True, 3, False, 9),
                        ("a", "t2", 0.83, 0.5, False, False, 2, True, 9), ("b", "t3", 0.82, 0.9, False, False, 1, True, 9)])
    own = {r.target_id: r.s1_id for r in resolve.owners(df).collect()}
    assert own == {"t1": "c", "t2": "a", "t3": "b"}
    assert {r.target_id for r in resolve.gate(resolve.owners(df), "lone", 0.84, 0.65).collect()} == {"t1", "t3"}
    assert {r.target_id for r in resolve.gate(resolve.owners(df), "lone", 0.82, 0.60).collect()} == {"t1", "t2", "t3"}
    assert {r.target_id for r in resolve.gate(resolve.owners(df), "blank_address", 0.84, 0.65).collect()} == {"t1"}
    assert {r.target_id for r in resolve.gate(resolve.owners(df), "signals", 0.84, 0.65).collect()} == {"t1"}
    assert {r.target_id for r in resolve.gate(resolve.owners(df), "none", 0, 0).collect()} == {"t1", "t2", "t3"}


@pytest.mark.parametrize(("pred", "gold", "want"), [([], [], 1), (["1"], [], 0), ([], ["1"], 0), (["1"], ["1"], 1), (["1", "2"], ["1"], 0.625 / 1.125), (["1", "1"], ["1"], 1)])
def test_f05(spark, pred, gold, want):
    ids = spark.createDataFrame([("s",)], "s1_id string")
    df = lambda xs: spark.createDataFrame([("s", x) for x in xs] or [("s", None)], "s1_id string, target_id string")
    assert metrics.entity_f05(ids, df(gold), df(pred)).first().f05 == pytest.approx(want)
    assert metrics.macro_f05(metrics.entity_f05(ids.where("false"), df(gold), df(pred))).first().macro_f05 == 0.0


def test_caps_and_partitions(spark, sf):
    """A cap keeps the first rows; the result doesn't depend on how the input is dealt."""
    e = E.fixture_entities(spark, sf).withColumn("ord", F.col("source").cast("long") * (1 << 40) + F.col("doc_id"))
    results = []
    for n in (1, 7):
        d = e.repartition(n)
        r = resolution.resolve(d.where("source = 1"), d.where("source > 1"), EXACT, keep=False)
        results.append(sorted(map(tuple, r.matches.collect())))
        owned = [x.target_id for x in r.owned.collect()]
        assert len(owned) == len(set(owned))
        assert {(x[0], x[1]) for x in results[-1]} <= {(c.s1_id, c.target_id) for c in r.candidates.collect()}
    assert results[0] == results[1] and results[0]


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_every_profile_runs(spark, sf, name):
    e = E.fixture_entities(spark, sf).withColumn("ord", F.col("source").cast("long") * (1 << 40) + F.col("doc_id"))
    r = resolution.resolve(e.where("source = 1"), e.where("source > 1"), PROFILES[name], keep=False)
    assert all(x.score >= PROFILES[name].cutoff for x in r.matches.collect())


def test_fair_quota(spark):
    found = spark.createDataFrame([("s", "a", f"t{i}", i) for i in range(4)] + [("s", "b", f"t{i}", i) for i in range(8)], "s1_id string, route string, target_id string, ord long")
    got = [r.target_id for r in blocking.fair_quota(found, [("a", 3), ("b", 3)], 5).orderBy("place").collect()]
    assert got == ["t0", "t1", "t2", "t3", "t4"]


def test_graph(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(41)} | {"x": "x", "y": "x", "z": "z"}


def test_folds_are_even(spark):
    c = spark.createDataFrame([(f"c{i}", 1 + (i % 7 == 0) * 3) for i in range(300)], "component string, size int")
    n = {}
    for r in graph.assign_folds(c).join(c, "component").collect():
        n[r.fold] = n.get(r.fold, 0) + r["size"]
    assert len(n) == 5 and max(n.values()) - min(n.values()) <= 5


def test_files(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text('id\tname\taddr\tcountry\nS1-1\tA "quoted" name\t1 x\tUS\nS1-2\tshort\n')
    rows = E.scan_lines(spark, str(p)).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'A "quoted" name', "1 x", "US"), ("S1-2", "short", "", "")]
    assert E.scan_sniffed(spark, str(p)).count() == 2
    c = tmp_path / "s.csv"
    c.write_text("entity_id,entity_name,country_code,zip\n1,A,US,75001\n")
    assert tuple(E.scan_named(spark, str(c)).first()) == ("1", "A", "", "US", "75001", "")
    j = tmp_path / "f.json"
    j.write_text('{"S1-1": 0, "S1-2": 3}')
    assert {(r.s1_id, r.fold) for r in E.fold_map(spark, str(j)).collect()} == {("S1-1", 0), ("S1-2", 3)}
    gold = spark.createDataFrame([("S1-1", "S2-1, S3-2,"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string")
    assert {(r.s1_id, r.target_id) for r in E.gold_links(gold).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", None)}
    out = tmp_path / "out"
    E.write_lists(E.joined_lists(spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string"), E.gold_links(gold).where("target_id is not null"), "matched_entity_ids"), str(out), single=True)
    text = next(out.glob("part-*")).read_text()
    assert text.splitlines() == ["s1_id\tmatched_entity_ids", "S1-1\tS2-1,S3-2", "S1-2\t"]
    assert audit.line_problems(spark, str(out)).count() == 0
    (tmp_path / "bad.tsv").write_text("a\tb\nno tab\na\tb\tc\n")
    assert {(r.problem, r.n) for r in audit.line_problems(spark, str(tmp_path / "bad.tsv")).collect()} == {("no_tab", 1), ("malformed", 1)}


def test_streaming(spark, sf, tmp_path):
    from sparlink.streaming.owners import OwnerTable, matches, start_resolution

    e = E.fixture_entities(spark, sf).withColumn("ord", F.col("source").cast("long") * (1 << 40) + F.col("doc_id"))
    e.where("source = 1").repartition(3).write.parquet(str(tmp_path / "in"))
    table = OwnerTable(spark, str(tmp_path / "owners"), EXACT.order)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_resolution(stream, e.where("source > 1"), EXACT, table, str(tmp_path / "checkpoint")).awaitTermination()
    want = resolution.resolve(e.where("source = 1"), e.where("source > 1"), EXACT, keep=False).matches
    key = lambda df: sorted((r.target_id, r.s1_id, r.score) for r in df.collect())
    assert key(matches(table, EXACT)) == key(want)


def test_package(spark, tmp_path):
    from sparlink.plans import package

    (tmp_path / "s1.tsv").write_text("id\tname\taddress\tcountry\nS1-1\ta\tb\tUS\nS1-2\ta\tb\tUS\n")
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    m, c, s1 = (str(tmp_path / x) for x in ("m.tsv", "c.tsv", "s1.tsv"))
    assert package.problems(spark, m, c, s1) == []
    package.pack({"m.tsv": m}, str(tmp_path / "out.zip"))
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-2\nS1-9\tX\n")
    found = " ".join(package.problems(spark, m, c, s1))
    assert all(x in found for x in ("missing_s1", "extra_s1", "wrong_prefix", "1 matches aren't candidates"))
