import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import distinctive, language, mixing, names, near_duplicates, packing, quality, reading_level, sentences, splitting
from loomtext.llm.tokens import counter

T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
DOC = "doc_id long, text string, source string, lang string, score double, rank int"


def docs(spark, *texts):
    rows = [(k, t, "usc", "en", 0.5, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def test_term_weights(spark):
    p = [("rare", 1, 5, T1), ("rare", 1, 1, T0), ("rare", 2, 1, T0), ("the", 1, 3, T0), ("the", 2, 3, T0), ("the", 3, None, T0), ("own", 1, 9, T0), (None, 1, 2, T0), ("x", None, 1, T0)]
    p = spark.createDataFrame(p + p[:2], "term string, doc_id long, term_freq int, indexed_at timestamp").selectExpr("*", "'z' as tf", "1 as df")
    probes = spark.createDataFrame([(1,), (1,), (99,), (None,)], "doc_id long")
    assert [tuple(r) for r in distinctive.most_characteristic(p, probes).collect()] == [(1, "rare")]
    w = {r["term"]: (r["tf"], r["df"]) for r in distinctive.term_weights(p, probes).collect()}
    assert w == {"rare": (5, 2), "the": (3, 3), "own": (9, 1)}
    assert distinctive.term_weights(p.limit(0), probes).count() == 0


def test_names(spark):
    m = [(1, "Bodrezokel Pacific Chemicals", "LLC"), (2, "B0drezokel Pacific Chem.", "L.L.C."), (3, "Bodrezokel P.C.", "LLC"), (4, "Bodrezokel Pacific Foods", "Inc."),
         (5, "Robert Nukegrofir", None), (6, "Nukegrofir, Bob", None), (7, "R. Nukegrofir", None), (8, "Thomas Nukegrofir", None), (9, None, None), (10, "", "x"), (1, "Bodrezokel Pacific Chemicals", "LLC")]
    m = spark.createDataFrame([(i, n, e, T0) for i, n, e in m], "match_id long, name string, entity_type string, extracted_at timestamp").selectExpr("*", "1 as ref", "2 as party")
    a = spark.createDataFrame([(7, {"Parties": ["the Licensee", "BODREZOKEL PACIFIC CHEMICALS LLC", '(each a "Party")', None]}), (8, None), (9, {})], "cuad_index int, clause_answers map<string,array<string>>")
    al = spark.createDataFrame([("Bob", "Robert"), (None, "x")], "short_form string, long_form string")
    got = {tuple(r) for r in names.variant_pairs(names.party_clusters(names.name_records(m, a), al, words=("pacific", "chemicals", "foods"))).collect()}
    company = {"c7.1", "m1", "m2", "m3"}
    person = {"m5", "m6", "m7"}
    assert got == {(x, y) for g in (company, person) for x in g for y in g if x < y}


def test_names_of_a_hot_party(spark):
    hot = [(k, ["Blackwater Logistics", "Blackwater Logistic"][k % 2], "Inc") for k in range(40)] + [(100 + k, f"{n} Harker", None) for k, n in enumerate(["John", "Mary", "J."] * 8)]
    m = spark.createDataFrame([(i, n, e, T0) for i, n, e in hot], "match_id long, name string, entity_type string, extracted_at timestamp")
    a = spark.createDataFrame([], "cuad_index int, clause_answers map<string,array<string>>")
    al = spark.createDataFrame([], "short_form string, long_form string")
    records = names.name_records(m, a)
    assert not names.frequent_words(records) & {"blackwater", "harker"}
    party = {r["ref"]: r["party"] for r in names.party_clusters(records, al).collect()}
    assert len(party) == len(hot) and len({party[f"m{k}"] for k in range(40)}) == 1
    assert len({party["m100"], party["m101"], party["m0"]}) == 3 and party["m100"] == party["m102"]
    assert names.Reader({}, {"blackwater": 1, "logistics": 9}).read("Blackwater Logistics Inc")[:3] == ("company", "blackwater", "logistics")
    assert names.Reader({}, {"bank"}).read("the Bank") is None
    assert names.Reader({}, {"marit": 3, "chem": 3, "maritime": 9, "chemicals": 9}).read("Nozusagoth Marit. Chem. LLC")[1:3] == ("nozusagoth", "chemicals maritime")


def test_pieces(spark):
    long = ("One sentence of some words ends here. " * 60).strip()
    d = docs(spark, long + "\n\nshort", "x" * 3000, "", None)
    g = spark.createDataFrame([(0, 0, 0, 2200, 300, T1), (0, 0, 0, 2200, None, T0), (1, 0, 0, 10, 5, T0), (77, 1, 0, 9, 999, T0)], "doc_id long, group_no int, start_char int, end_char int, unit_token_sum int, packed_at timestamp")
    s = spark.createDataFrame([("paragraph_chars", 1200, 100), ("group_tokens", 256, 32)], "setting_key string, max_size int, overlap_size int")
    out = [r.asDict() for r in splitting.oversized_pieces(d, g, s).orderBy("item_kind", "doc_id", "item_no", "piece_no").collect()]
    assert {(r["item_kind"], r["doc_id"], r["item_no"]) for r in out} == {("paragraph", 0, 0), ("paragraph", 1, 0), ("group", 0, 0), ("group", 77, 1)}
    par = [r for r in out if r["item_kind"] == "paragraph" and r["doc_id"] == 0]
    assert all(len(r["piece"]) <= 1200 for r in par) and "".join(r["piece"][r["overlap_chars"] :] for r in par) == long
    assert all(r["overlap_chars"] == 100 for r in par[1:]) and par[0]["piece"].endswith(".")
    grp = [r for r in out if r["item_kind"] == "group" and r["doc_id"] == 0]
    assert all(len(r["piece"].split()) <= 256 for r in grp) and all(len(r["piece"][: r["overlap_chars"]].split()) == 32 for r in grp[1:])
    assert splitting.oversized_items(d.limit(0), g.limit(0), s).count() == 0


def test_text_class(spark):
    prose = "The clerk filed the report with the county. It was read in the afternoon by the board. " * 3
    table = "\n".join(f"| lamp | {k} | 3.5 |" for k in range(9))
    listed = "\n".join(f"- lamp oil, hand saw Abaro {k}" for k in range(9))
    junk = "\n".join("00000010  67 4b be 35 d7 9a 46 b3" for _ in range(9))
    d = docs(spark, prose, table, listed, junk, "", None, prose * 300)
    got = [r["text_class"] for r in quality.text_quality(d).orderBy("doc_id").collect()]
    assert got == ["prose", "table", "list", "junk", "junk", "junk", "prose"]
    assert quality.text_quality(d.limit(0)).count() == 0


def split(t):
    return [t[s:e] for s, e in sentences.split_sentences(t)]


def test_sentences(spark):
    assert split("Dr. Moss met Mr. Hale at 5 p.m. on the pier. The rate rose by 1.5 percent! Was it J. R. Moss?") == [
        "Dr. Moss met Mr. Hale at 5 p.m. on the pier.", "The rate rose by 1.5 percent!", "Was it J. R. Moss?"]
    assert split('He asked: "Who holds it? Who knows?" and left. We wait.') == ['He asked: "Who holds it? Who knows?" and left.', "We wait."]
    assert split("Das ist am 1. Januar fällig! Kapitel 17. Dagegen nicht.") == ["Das ist am 1. Januar fällig!", "Kapitel 17.", "Dagegen nicht."]
    assert split("他写道：“今天。明天。”并离开了。期限！") == ["他写道：“今天。明天。”并离开了。", "期限！"]
    assert split("No end\n\nAnother one") == ["No end", "Another one"] and split("") == [] and split(None) == []
    d = docs(spark, "It covers ships, rafts, etc. The crew left.", None, "", "   ")
    out = sentences.sentences(d).orderBy("doc_id", "sentence_no").collect()
    assert all(r["doc_id"] == 0 for r in out) and sentences.sentences(d.limit(0)).count() == 0


def near_pairs_brute(texts):
    sets = [{u[i : i + 9] for i in range(len(u) - 8)} for u in (near_duplicates.normalise(t or "") for t in texts)]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}


def test_near_duplicates(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("alpha beta gamma delta omega sigma kappa zeta".split()) + str(rnd.randrange(400)) for _ in range(90)) for _ in range(8)]
    texts = base + [b.replace("alpha", "ALPHA", 2) + " tail" for b in base[:5]] + [base[0], "", None, "tiny", "tiny"] + ["some copied text that is long enough"] * 30
    d = docs(spark, *texts)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(d).collect()}
    assert got == near_pairs_brute(texts)
    cls = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(d).collect()}
    assert len(cls) == len(texts) and cls[8] == 0 and cls[13] == 0
    assert near_duplicates.near_duplicate_pairs(d.limit(0)).count() == 0


def test_bit_slices():
    w = np.random.default_rng(0).integers(-(2**62), 2**62, (130, 5))
    w[7] = w[9]
    d = np.unpackbits((w[:, None] ^ w[None]).view(np.uint8), axis=2).sum(axis=2)
    for r in (0, 100, 150, 165):
        x, y = near_duplicates.block_within(w, w, r)
        assert sorted(zip(x.tolist(), y.tolist())) == sorted(map(tuple, np.argwhere(d <= r).tolist()))


def test_tiles_lose_nothing(spark):
    texts = [f"the very same report on ships and rafts with number {k % 50} at its end and more words" for k in range(60)]
    d = docs(spark, *texts)
    _, a = near_duplicates.copies_and_links(d, tile=4)
    _, b = near_duplicates.copies_and_links(d)
    assert {tuple(r)[:2] for r in a.collect()} == {tuple(r)[:2] for r in b.collect()}


def test_near_duplicates_at_the_threshold(spark):
    rnd = random.Random(5)
    texts = []
    for k in range(150):  # resemblance just above 0.5: the first half of the texts is shared
        n = rnd.choice([60, 300, 1500])
        word = lambda m: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(m)).strip().replace("  ", "x")
        shared = word(n)
        texts += [shared + word(int(n * 0.46)), shared + word(int(n * 0.46))]
    want = near_pairs_brute(texts)
    assert len(want) >= 100
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(docs(spark, *texts)).collect()} == want


def test_reading_level(spark):
    assert [reading_level.syllables(w) for w in "cat table making organization the jumped needed".split()] == [1, 2, 2, 5, 1, 1, 2]
    easy = "The cat sat on the mat. The dog ran to the bus. He has a big red hat. " * 8
    hard = "The constitutional interpretation of institutional responsibility necessitates epistemological sophistication, administrative reorganization and the interdisciplinary representation of thermodynamic heterogeneity in the international administration. " * 5
    d = docs(spark, easy, hard, None, "")
    given = spark.createDataFrame([], "doc_id long, flesch_kincaid_grade double, scored_at timestamp")
    texts = language.train([("en", k, easy + hard) for k in range(4)], 24000)
    got = {r["doc_id"]: r["band"] for r in reading_level.reading_levels(d, given, texts).where("is_english_prose").collect()}
    assert got == {0: "easy", 1: "hard"}


def test_reading_level_counts_every_document(spark):
    cited = ("The municipal administration reorganized institutional responsibilities pursuant to Art. 12 of the regulation and No. 5 of the supplementary "
             "organizational provisions in Moss v. Smith and the interdisciplinary recommendations of the constitutional committee. ") * 6  # fmt: skip
    middle = "The committee will discuss the annual report on Monday and vote on the proposal of the members. " * 8
    d = docs(spark, cited, middle)
    given = spark.createDataFrame([], "doc_id long, flesch_kincaid_grade double, scored_at timestamp")
    texts = language.train([("en", k, cited + middle) for k in range(4)], 24000)
    few, all_ = ({r["doc_id"]: r for r in reading_level.reading_levels(d, given, texts, head=h).collect()} for h in (3, 65_536))
    assert few == all_ and few[1]["coverage_rank"] > 4  # the head is no bound of the ranks
    assert all_[0]["band"] == "hard" and 8 < all_[1]["grade"] < 17 and all_[1]["band"] == "medium"
    assert all_[0]["is_english_prose"] and all_[1]["is_english_prose"]


def test_hilbert_is_a_bijection():
    pts = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    k = packing.hilbert_key(pts, 3)
    o = pts[np.argsort(k)]
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(o, axis=0)).sum(axis=1) == 1).all()


def test_pack(spark):
    d = docs(spark, *["word " * (10 + k) for k in range(40)], "long " * 300, "", None)
    out = packing.pack(d, 100).collect()
    used = {}
    for r in out:
        used.setdefault(r["container_id"], []).append((r["position"], r["start_token"], r["n_tokens"]))
    assert all(sum(n for _, _, n in v) <= 100 and sorted(p for p, _, _ in v) == list(range(len(v))) for v in used.values())
    count = counter()
    want = {k: count(t) for k, t in enumerate(["word " * (10 + k) for k in range(40)] + ["long " * 300, ""])}
    have = {}
    for r in out:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["n_tokens"]
    assert have == want and packing.pack(d.limit(0), 100).count() == 0


def test_budgets():
    leaves = [("law", "en", "usc", 1000), ("law", "en", "court", 100), ("web", "en", "web", 5000)]
    plan, total = mixing.budgets(leaves, {"usc": (0.5, 1), "court": (0.2, 2), "web": (0.3, 1), "gone": (0.5, 1)}, 1500)
    assert plan["law", "en", "court"] == 200 and plan["law", "en", "usc"] > 750 and abs(sum(plan.values()) - total) < 5
    plan, total = mixing.budgets(leaves, {"usc": (0.5, 1), "court": (0.2, 2), "web": (0.3, 1)}, None)
    assert total == 1000 and plan["law", "en", "court"] == 200
    assert mixing.budgets([], {}, None) == ({}, 0)


def test_mix(spark):
    d = spark.createDataFrame([(k, "word " * 20, ["usc", "USC ", "court-orders", None][k % 4], "en") for k in range(400)], "doc_id long, text string, source string, lang string")
    t = spark.createDataFrame([("usc", 0.5, 1), ("court_orders", 0.5, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(d, t)
    assert chosen.where("repeats > 3 or (source = 'usc' and repeats > 1)").count() == 0
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 for r in shares.collect())
    assert mixing.mix(d.limit(0), t)[0].count() == 0


def test_language():
    assert [language.base_code(x) for x in ("en-US", "EN", "deu", "und", None, "zh_CN")] == ["en", "en", "de", None, None, "zh"]
    a = language.Automaton("banana")
    assert a.pieces("nanab") == 2 and a.pieces("banana") == 1 and a.pieces("xx") == 2
    en = "The board keeps the record of the harbour and the fee. The clerk reads the letter to the board. "
    fr = "Le conseil garde le registre du port et de la taxe. Le greffier lit la lettre devant le conseil. "
    m = language.Model(language.train([("en", k, en * 3) for k in range(4)] + [("fr", k, fr * 3) for k in range(4)], 24000))
    got = [x[2] for x in language.stretches(en * 4 + "\n\n" + fr * 4, m)]
    assert got == ["en", "fr"] and language.stretches("123 456", m) == []


def test_language_tables(spark):
    d = docs(spark, None, "", "The board keeps the record. " * 5)
    assert language.document_languages(d.limit(0), {}).count() == 0
    assert language.fit(d.limit(0)) == {}
    assert language.document_languages(d, language.fit(d)).where("doc_id < 2").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_char_pattern_round_trip(spark, seed):
    rnd = random.Random(seed)
    t = "".join(rnd.choice("ab .,;\n。é") for _ in range(700)).strip() or "x"
    df = spark.createDataFrame([(t,)], "t string").select(splitting.pieces(splitting.F.col("t"), splitting.char_pattern(40)))
    got = df.first()[0]
    assert "".join(got) == t and all(len(p) <= 40 for p in got)


def test_names_in_any_order_and_without_lists(spark):
    kinds = ["Chemicals", "Textiles", "Shipping", "Foods", "Mining", "Optics"]
    own = ["Gorelath", "Bezunark", "Mifudrol", "Trosavin", "Kalubrex", "Pondimar", "Saviteth"]
    rows = [(k, f"{o} {a} {b}", "Inc.") for k, (o, a, b) in enumerate((o, kinds[i % 6], kinds[(i + 1) % 6]) for o in own for i in range(6))]
    rows += [(100, "Zorblat Quimvar Chemicals Textiles", "LLC"), (101, "Quimvar Zorblat Chemicals Textiles", "LLC"), (102, "Zorblat Quimvar Chem. Textiles", "LLC")]
    m = spark.createDataFrame(rows, "match_id int, name string, entity_type string").withColumn("extracted_at", F.lit(1))
    a = spark.createDataFrame([], "cuad_index int, clause_answers map<string,array<string>>")
    al = spark.createDataFrame([], "short_form string, long_form string")
    records = names.name_records(m, a)
    got = {r["ref"]: r["party"] for r in names.party_clusters(records, al).collect()}
    assert got["m100"] == got["m101"] == got["m102"] and got["m0"] != got["m1"]
    links = {r["ref"]: r["n_links"] for r in names.with_links(names.party_clusters(records, al)).collect()}
    assert links["m100"] == 2 and links["m0"] == 0


def test_sentences_far_apart():
    far = "The first one ends." + " " * 80 + "The second one ends."
    assert len(sentences.split_sentences(far)) == 2


def test_long_units_keep_their_language():
    en = "The crew left the harbour and the rate was paid by the owner of the ship. We wait for the first report of the year. "
    fr = "Le navire quitte le port et le taux est payé par le propriétaire. Nous attendons le premier rapport de cette année. "
    m = language.Model(language.train([("en", k, en * 3) for k in range(4)] + [("fr", k, fr * 3) for k in range(4)], 24000))
    unit = fr.replace(".", ",") * 9000  # about a million characters without a sentence end
    (s, e, lang, conf), *more = language.stretches(unit, m)
    assert lang == "fr" and not more and conf > 0.2


def test_wrong_labels_dont_teach():
    en = ["The crew left the harbour and the rate was paid by the owner.", "We wait for the report of the year and the ship.", "No one of the owners was on the pier at the time."]
    de = ["Das Schiff hat den Hafen verlassen und der Preis wurde bezahlt.", "Wir warten auf den Bericht und auf das Schiff.", "Niemand von den Besitzern war zu der Zeit auf dem Pier."]
    for seed in range(5):
        rnd = random.Random(seed)
        say = lambda xs: " ".join(rnd.choice(xs) for _ in range(6))
        rows = [("en", k, say(en)) for k in range(20)] + [("de", 100 + k, say(de)) for k in range(17)] + [("de", 200 + k, say(en)) for k in range(3)]
        m = language.Model(language.train(rows, 24000))
        assert [x[2] for x in language.stretches(say(en) + "\n\n" + say(de), m)] == ["en", "de"]


def test_repetition_is_junk():
    line = "The owner of the ship shall pay the rate of the harbour when the crew has left it again."
    other = "Nobody knew how long the storm would last, and the old captain told them to wait below."
    assert quality.text_class("\n".join([line] * 3 + [other])) == "junk"
    assert quality.text_class(line + "\n" + other) == "prose"
    assert quality.text_class("buy now " * 200) == "junk"


def test_estimate_selects(spark):
    feats = spark.createDataFrame([(k, 10 + k % 30, 5.0 + k % 20, 4.0 + k % 3, 0.4 * (5 + k % 20) + 4.0 * (4 + k % 3) - 20, None) for k in range(60)],
                                  "doc_id long, coverage_rank int, words_per_sentence double, letters_per_word double, grade double, is_english_prose boolean")
    given = feats.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit(400.0)).otherwise(F.col("grade")).alias("flesch_kincaid_grade"), F.lit(1).alias("scored_at"))
    off = reading_level.calibrated(feats, given).select(F.max(F.abs(F.col("estimate") - F.col("grade"))).alias("m")).first()["m"]
    assert off < 0.01


def test_mixing_redistributes_among_siblings():
    leaves = [("law", "en", "a", 100), ("law", "en", "b", 1000), ("web", "en", "c", 1000)]
    plan, total = mixing.budgets(leaves, {"a": (0.4, 1), "b": (0.2, 1), "c": (0.4, 1)}, 600)
    assert plan["law", "en", "a"] == 100 and plan["law", "en", "b"] == 260 and plan["web", "en", "c"] == 240 and total == 600


def test_recall_by_similarity():
    rng = np.random.default_rng(1)
    for alike in (0.5, 0.55, 0.6):
        found = 0
        for k in range(200):
            n = (120, 600, 1500)[k % 3]
            h = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            shared = round(n * alike)
            own = (n - shared) // 2
            two = [np.sort(np.concatenate([h[:shared], part])) for part in (h[shared : shared + own], h[shared + own :])]
            s = np.stack([near_duplicates.sketch(x) for x in two])
            bands, bits = near_duplicates.bands_of(s), near_duplicates.bits_of(s).view(np.uint8)
            differ = int(np.unpackbits(bits[0] ^ bits[1]).sum())
            found += bool((bands[0] == bands[1]).any()) and differ <= 96 + 3.25 * (72 * (1 + 96 / len(two[0]))) ** 0.5 + 1
        assert found >= 197
