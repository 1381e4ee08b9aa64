"""The pipeline's stages against brute-force versions, each on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from wildgrid.llm import bloom, packing, secrets, substring, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(21)
    prose = lambda n: " ".join(f"v{rnd.randint(0, 4000)}" for _ in range(n))
    passage = prose(55)
    rows, labels = [], []
    for i in range(400):
        text = prose(rnd.randint(30, 160))
        bad = i % 8 == 0
        if bad:
            words = text.split()
            for _ in range(5):
                words.insert(rnd.randrange(len(words)), rnd.choice(("idiot", "scum", "trash")))
            text = " ".join(words)
        if i % 10 == 3:
            text = f"{text} {passage} {prose(20)}"
        if i == 5:
            text += " password = hunter2hunter2"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(400, rows[1][1], "en", "s", 0), (401, rows[2][1] + " more", "en", "s", 0), (402, None, "en", "s", None), (403, "", None, None, 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    docs = corpus_pipeline.table(spark, corpus, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]

    def step(name, docs):
        return corpus_pipeline.materialise(stages[name](spark, docs, corpus), name)

    clean = step("toxicity", docs)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, corpus_pipeline.table(spark, corpus, "labels"))).collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {i for i, s in scores.items() if s < 0.3}
    assert sum(i % 8 == 0 for i in kept if i < 400) <= 3 and len(kept) >= 345

    alone = step("simhash_near_dedup", clean)
    left = {r.doc_id for r in alone.collect()}
    assert kept - left == {400, 401, 403}  # 402 and 403 have no words: one of them stays

    cut = step("substring_dedup", alone)
    want = {i: n for i, _, n, _ in substring.substring_brute([(r.doc_id, r.text) for r in alone.collect()])}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (alone, cut))
    assert all(len((before[i] or "").split()) - len((after[i] or "").split()) == n for i, n in want.items())
    assert all(after[i] == before[i] for i, n in want.items() if not n) and sum(n >= 55 for n in want.values()) >= 30

    safe = step("secret_scan", cut)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert "hunter2" not in texts[5] and all(texts[i] == after[i] for i in texts if i != 5)
    assert clean.columns == alone.columns == cut.columns == safe.columns == columns

    bins = step("best_fit_packing", safe).collect()
    assert {i for b in bins for i in b.doc_ids} == set(texts)
    assert sum(b.used for b in bins) == sum(len((t or "").split()) + 1 for t in texts.values())


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_pipeline(rows, scores):
    """The five stages over (doc_id, text), one after the other; scores: of toxicity, whose definition is tested by itself."""
    kept = [(i, t) for i, t in rows if scores[i] < 0.3]
    home, sets = {i: i for i, _ in kept}, {i: shingles(t) for i, t in kept}
    for i in home:
        for j in home:
            both = len(sets[i] & sets[j])
            if i < j and home[i] != home[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((home[i], home[j]))
                home = {d: low if h == high else h for d, h in home.items()}
    alone = [(i, t) for i, t in kept if home[i] == i]
    least = {}
    for i, t in alone:
        w = (t or "").split()
        for k in range(len(w) - 12):
            least[tuple(w[k : k + 13])] = min(i, least.get(tuple(w[k : k + 13]), i))
    encode, cut = secrets.load(secrets.default_vocabulary()).encode_ordinary, []
    for i, t in alone:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        t = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        spans = [(m.start(2), m.end(2)) for m in secrets.ASSIGN.finditer(t or "") if len(m[2]) >= 6]
        spans += [s[1:] for s in secrets.base_spans(t or "") + secrets.random_spans(t or "", encode) if s[0] != "assign"]
        hidden = {c for a, b in spans for c in range(a, b)}
        if hidden:
            t = "".join("[SECRET]" if c in hidden and c - 1 not in hidden else "" if c in hidden else x for c, x in enumerate(t))
        cut.append((i, len((t or "").split()) + 1))
    pieces = [(i, s, min(4096, n - s)) for i, n in sorted(cut) for s in range(0, n, 4096)]
    return sorted((c, [pieces[k][0] for k in b], [pieces[k][1] for k in b], [pieces[k][2] for k in b]) for c, b in packing.pack([p[2] for p in pieces]))


def test_run_equals_brute_force(spark, corpus):
    bins = corpus_pipeline.run(spark, corpus).collect()
    docs = corpus_pipeline.table(spark, corpus, "documents")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, corpus_pipeline.table(spark, corpus, "labels"))).collect()}
    want = brute_pipeline([(r.doc_id, r.text) for r in docs.collect()], scores)
    assert sorted((b.capacity, b.doc_ids, b.starts, b.sizes) for b in bins) == want
    assert all(sum(b.sizes) == b.used <= b.capacity for b in bins)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, doc int, twin int, spans int, cut int, n_words int, kept boolean, score double"


def test_stages_on_awkward_tables(spark, corpus):
    """Null ids and columns, repeated rows, a very long text and clashing names pass through every stage; an empty table gives an empty one."""
    rnd = random.Random(23)
    same = " ".join(f"v{rnd.randint(0, 4000)}" for _ in range(40))
    long_ = " ".join(f"v{rnd.randint(0, 4000)}" for _ in range(30_000))
    more = ("h", 1, 2, 3, 4, 5, True, 0.5)
    rows = [(None, same, None, None, None), (None, same, None, None, None), (None, None, None, None, None), (1, same, "en", "s", 0), (1, same, "en", "s", 0), (1, "quite another text", "en", "s", 0), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 0), (4, long_, None, "s", 0)]
    docs = spark.createDataFrame([(*r, *more) for r in rows], AWKWARD)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = (corpus_pipeline.materialise(stage(spark, d, corpus), name) for d in (docs, empty))
        got = docs.collect()
        assert docs.columns == empty.columns == [c.split()[0] for c in AWKWARD.split(", ")] and empty.count() == 0
        assert all(tuple(r)[5:] == more for r in got)
    assert sum(r.doc_id is None for r in got) == 3 and sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 1, 2, 4]
    assert len({r.text for r in got if r.doc_id == 1}) == 2
    pack = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    assert pack(spark, empty, corpus).count() == 0
    assert sum(len(b.doc_ids) for b in pack(spark, docs, corpus).collect()) == 6 + -(-30_001 // 4096)


def test_near_duplicates_of_repeated_ids(spark):
    rnd = random.Random(22)
    one, two, three = (" ".join(f"v{rnd.randint(0, 4000)}" for _ in range(60)) for _ in range(3))
    rows = [(1, one), (2, one + " more"), (2, two), (3, three), (3, three), (4, two), (5, None), (5, ""), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, one), (2, two), (3, three), (5, ""), (0, one), (0, one)])


def shuffled(spark) -> int:
    """Bytes that all stages of the session have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_duplicates_do_not_shuffle_other_texts(spark):
    rnd = random.Random(24)
    texts = [" ".join(f"{rnd.getrandbits(32):08x}" for _ in range(1000)) for _ in range(200)]
    rows = [*enumerate(texts), (200, texts[3] + " more"), (201, texts[3]), (202, texts[5])]
    docs = corpus_pipeline.materialise(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id int, text string, lang string, source string, n_chars long"), "docs")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        before = shuffled(spark)
        got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got == list(range(200))
    assert 0 < moved < sum(map(len, texts)) / 2


def test_bloom_filter_passes_every_listed_row(spark):
    rows = spark.range(4000).selectExpr("cast(id as int) id", "if(id % 10 = 9, null, concat('t', id)) name", "id block")
    listed = spark.range(0, 4000, 40).selectExpr("id", "concat('t', id) name")
    for blocks in (1, 1 << 16):  # one block has 256 bits for 100 keys
        got = bloom.possible(rows, listed, ["id", "name"], "maybe", blocks).collect()
        assert len(got) == 4000 and got[0].block == got[0].id
        assert all(r.maybe for r in got if r.id % 40 == 0)
        assert sum(r.maybe for r in got) < (110 if blocks > 1 else 4000)
    assert not bloom.possible(rows, listed.limit(0), ["id", "name"], "maybe").where("maybe").count()
