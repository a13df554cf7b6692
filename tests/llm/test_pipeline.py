import corpus_pipeline
from paperloom.llm import shared

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    assert docs.select("text").distinct().count() == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.selectExpr("max(offset + length)").first()[0] <= 1024


def test_last_stage_has_the_token_ids(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {}
    for row in sorted(corpus_pipeline.pack_sequences(spark, docs, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(row.ids) == row.length
        ids.setdefault(row.doc_id, []).extend(row.ids)
    whole = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    assert ids == {i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in text.items()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_run_equals_brute_force(spark, tmp_path):
    import random

    from tokenizers import Tokenizer

    from .test_jaccard import brute

    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(prose(rng.randint(8, 60))) for _ in range(160)]
    toxic = [" ".join([*prose(10), rng.choice(["vile", "rotten", "scum"]), *prose(10), "vile"]) for _ in range(60)]
    near = []
    for n in range(12):  # families of near copies of one text
        w = prose(70)
        near += [" ".join([*w[:i], f"x{n}y{i}", *w[i + 1 :]]) for i in rng.sample(range(70), 4)]
    secret = "password=q1w2e3r4t5y6u7i8"
    rest = [f"{secret} {' '.join(prose(12))}", f"bare q1w2e3r4t5y6u7i8 {' '.join(prose(12))}", None, "", None, texts[3], texts[3], texts[5], near[0]]
    rest += [f"token=copied1copied1copied1 {' '.join(prose(12))}" for _ in range(6)]
    every = texts + toxic + near + rest
    order = list(range(len(every)))
    rng.shuffle(order)
    rows = [(i, every[n], "en", f"s{n % 7}", len(every[n]) if every[n] is not None else None, "more") for i, n in enumerate(order)]
    is_toxic = {i: 160 <= n < 220 for i, n in enumerate(order)}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_id` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(is_toxic[i])) for i in range(0, len(rows), 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    clean = [(i, t) for i, t, *_ in rows if not is_toxic[i]]
    last = {t or "": i for i, t in clean}  # of equal texts the largest id
    alone = [(i, t) for i, t in clean if last[t or ""] == i]
    kept = {int(i): t for (i, _, component), t in zip(sorted(brute(alone)), [t for _, t in sorted(alone, key=lambda x: str(x[0]))]) if i == component}
    assert len(kept) < len(alone) < len(clean) < len(rows)
    want = {}
    whole = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    for i, t in kept.items():
        masked = (t or "").replace(secret, "[SECRET]").replace("q1w2e3r4t5y6u7i8", "[SECRET]")
        want[i] = whole.encode(masked, add_special_tokens=False).ids + [2]
    got, bins = {}, {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got.get(r.doc_id, [])) and r.length == len(r.ids)
        got.setdefault(r.doc_id, []).extend(r.ids)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
