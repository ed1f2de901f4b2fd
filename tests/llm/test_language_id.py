from collections import Counter

from tallyweave.llm import language_id as m


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = m.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98


def test_distance_against_plain(spark):
    train = [("aa", "abc abd abe"), ("aa", "abc"), ("bb", "xyz xyw xy"), (None, "q"), ("bb", None)]
    profiles = m.language_profiles(spark.createDataFrame(train, "lang string, text string"), 50)

    def grams(texts):
        counts = Counter()
        for text in texts:
            for word in text.split():
                padded = " " + word + " "
                counts.update(padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1) if len(padded[i:i + n].strip()) > 0)
        key = {g: sum(ord(c) << 16 * k for k, c in enumerate(reversed(g))) for g in counts}
        return [key[g] for g in sorted(counts, key=lambda g: (-counts[g], key[g]))]

    plain = {lang: grams([t for x, t in train if x == lang and t]) for lang in ("aa", "bb")}
    three = lambda p: [g for g in p if not (g >> 32 and (g >> 16 & 0xFFFF) == 32)]
    assert profiles == {k: three(v)[:50] for k, v in plain.items()}
    doc = three(grams(["abx xy"]))[:m.PROFILE]
    cost = {k: sum(abs(p.index(g) - i) if g in p else m.PROFILE for i, g in enumerate(doc)) for k, p in profiles.items()}
    best = min(sorted(cost), key=cost.get)
    got = m.predict_language(spark.createDataFrame([("abx xy",)], "text string"), profiles).first()
    assert got["lang_pred"] == best and abs(got["score"] - (1 - cost[best] / (len(doc) * m.PROFILE))) < 1e-12


def test_edges(spark):
    train = spark.createDataFrame([("en", "the cat and the hat"), ("de", "der und die das")], "lang string, text string")
    profiles = m.language_profiles(train)
    rows = [(1, None, 1), (2, "", 1), (3, "12 !?", 1), (4, "THE HAT " * 20000, 1), (5, "der\nund", 1), (5, "der\nund", 1), (6, "𝒳𝒴 🙂", 1)]
    got = [(r["doc_id"], r["lang_pred"]) for r in m.predict_language(
        spark.createDataFrame(rows, "doc_id long, text string, score int"), profiles).collect()]
    assert dict(got[:5]) == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de"} and len(got) == 7
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert m.language_query(empty).count() == 0 and m.language_profiles(empty.select("lang", "text")) == {}
    assert m.predict_language(spark.createDataFrame(rows[3:4], "doc_id long, text string, x int"), {}).first()["lang_pred"] == "und"


def test_many_languages_in_blocks(spark, monkeypatch):
    # Words of a language are its number in letters, so that every text has one best language.
    word = lambda k: "".join(chr(97 + k // 26 ** i % 26) for i in range(3))
    rows = [(f"l{k:04d}", " ".join([word(k), word(k) + word(k)] * 3)) for k in range(1200)]
    train = spark.createDataFrame(rows, "lang string, text string")
    docs = spark.createDataFrame([(k, rows[k][1].upper()) for k in range(0, 1200, 7)] + [(-1, None), (-2, "12")],
                                 "_judged long, text string")
    table = m.profile_table(train)
    got = {r["_judged"]: (r["lang_pred"], r["score"]) for r in m.predict_language(docs, table).collect()}
    assert all(got[k] == (f"l{k:04d}", 1.0) for k in range(0, 1200, 7)) and got[-1] == got[-2] == ("und", 0.0)
    some = docs.limit(40)
    small = table.where("lang < 'l0300'")
    whole = m.predict_language(some, small).orderBy("_judged").collect()
    monkeypatch.setattr(m, "MATRIX", 7)
    assert m.predict_language(some, small).orderBy("_judged").collect() == whole
    monkeypatch.setattr(m.profile_blocks, "__defaults__", (110,))
    assert m.predict_language(some, small).orderBy("_judged").collect() == whole


def test_stage_keeps_languages_and_columns(spark):
    rows = [(k, "the cat and the hat sat", "en", 0.5) for k in range(5)] + [(9, "12 34", "en", 0.5), (10, None, "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = m.drop_foreign(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 4]
    unlabelled = spark.createDataFrame([(1, "words", None), (2, "12", None), (3, None, None)],
                                       "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in m.drop_foreign(unlabelled).collect()] == [1]


def test_stage_drops_foreign_and_gibberish(spark, sf):
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
        "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił",
        "Mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan",
        "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler",
        "Watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri hivyo yapasa",
        "xqzv kjwq zzxp qwrt plkj vbnm zxcv qqwx jkhz wvxq pzkq mxnz hjqk xwvz qkjx"]
    clean = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    long = clean.where("length(text) > 400").limit(40).collect()
    # Clean texts without a label, whole and short, stay beside the labelled ones.
    own = [(-1000 - k, text, None) for k, text in enumerate(
        [r["text"] for r in long[:20]] + [" ".join(r["text"].split()[:6]) for r in long[20:]])]
    odd = [(-1 - k, text, None) for k, text in enumerate(foreign + [" ".join([t] * 300) for t in foreign])]
    docs = clean.unionByName(spark.createDataFrame(own + odd, "doc_id long, text string, lang string"))
    got = {r["doc_id"] for r in m.drop_foreign(docs).collect()}
    assert got == {r["doc_id"] for r in clean.collect()} | {d for d, _, _ in own}
