"""Seen keys, packing, leaks and sentences: brute force, exact accounts, edge cases and skew."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from verslog.llm import leak, pack, seen, sentences


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- keys seen before ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
    sizes, bits, prints = seen.build_sealed(h1, h2)
    flat = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=sum(sizes)).astype(bool)
    slot, has = seen.find_slots(h1, h2, sizes, flat)
    assert has.all() and sorted(slot) == list(range(n)) and len(prints) == 4 * n
    if n:
        assert 8 * (len(bits) + len(prints)) / n < 50


def test_equal_hashes_are_an_error():
    with pytest.raises(ValueError):
        seen.build_sealed(np.zeros(2, dtype=np.uint64), np.zeros(2, dtype=np.uint64))


EARLIER, INCOMING = "key binary, arrival_id string, matched int", "arrival_id long, key binary, part string"


def test_seen_brute_force(spark):
    rnd = random.Random(1)
    pool = [b"", b"\x00", b"hot", b"hot\x00", "größe".encode(), b"\xff\xfe", b"x" * 5000, *[b"k%d" % i for i in range(400)]]
    old = [rnd.choice([None, b"hot", *pool[:200]]) for _ in range(2000)]
    new = [(i, rnd.choice([None, b"hot", b"hot", *pool])) for i in rnd.sample(range(10**6), 3000)]
    known, want = set(old), []
    for i, k in sorted(new, key=lambda x: x[0]):
        if k is not None and k in known:
            want.append((i,))
        known.add(k)
    earlier = spark.createDataFrame([(k, "clash", 0) for k in old], EARLIER)
    incoming = spark.createDataFrame([(i, k, "clash") for i, k in new], INCOMING)
    assert rows(seen.seen_before(earlier, incoming, "key", "arrival_id")) == sorted(want, key=repr)
    got = {r.fingerprint_bits: r for r in seen.error_rate(earlier, incoming, "key", "arrival_id", (1, 32)).collect()}
    assert got[32].wrong == 0 == got[32].missed == got[1].missed and got[1].asked == got[32].asked
    assert 0.1 < got[1].wrong_rate < 0.7  # one bit: about half of the new keys that meet a slot


def test_seen_with_empty_tables(spark):
    some = spark.createDataFrame([(1, b"a", ""), (2, b"a", ""), (3, None, "")], INCOMING)
    none = spark.createDataFrame([], EARLIER)
    assert rows(seen.seen_before(none, some, "key", "arrival_id")) == [(2,)]
    assert seen.seen_before(some.select("key"), some.where("false"), "key", "arrival_id").count() == 0
    assert rows(seen.seen_before(some.select("key"), some, "key", "arrival_id")) == [(1,), (2,)]


def test_generations_are_all_asked(spark):
    keys = lambda x: spark.createDataFrame([(i, k) for i, k in enumerate(x)], "id long, key binary")
    index = seen.seal(keys([b"a", b"b"]), "key", 3).unionByName(seen.seal(keys([b"c", b"c", None]), "key", 3, generation=1))
    assert index.agg(F.sum("keys")).first()[0] == 3
    assert [r.matched == 32 for r in seen.probe(keys([b"a", b"c", b"zz"]), "key", "id", index, 3).orderBy("id").collect()] == [True, True, False]


def test_a_sealed_set_in_a_folder(spark, tmp_path):
    rnd, known, n = random.Random(9), set(), 0
    make = lambda: seen.SealedKeys(spark, f"file://{tmp_path}/sealed", most=3)
    earlier = [b"k%d" % i for i in range(60)] + [None, b""]
    make().hold(spark.createDataFrame([(k, "c") for k in earlier], "key binary, h1 string"), "key")
    known |= {k for k in earlier if k is not None}
    most = 0
    for step in range(1, 6):
        batch = []
        for _ in range(40):
            n += 1
            batch.append((n, rnd.choice([None, b"hot", b"k%d" % rnd.randrange(40 * step)]), "clash"))
        df, want = spark.createDataFrame(batch, "arrival_id long, key binary, part string"), set()
        for i, k, _ in batch:
            want |= {i} if k is not None and k in known else set()
            known |= {k} - {None}
        before = {r.arrival_id for r in make().seen(df, "key", "arrival_id").collect()}
        assert before == want == {r.arrival_id for r in make().apply(df, "key", "arrival_id", step).collect()}  # each time by another process
        most = max(most, make().generations())
    assert want == {r.arrival_id for r in make().apply(df, "key", "arrival_id", 5).collect()}  # a step that is repeated
    assert most <= 2 and make()._hashes_of(make()._state()["steps"]).count() == len(known)
    with pytest.raises(ValueError):
        make().hold(df, "key")
    make().close()


def test_batches_of_arrivals(spark):
    rnd = random.Random(2)
    new = [(i, rnd.choice([None, b"hot", *[b"k%d" % x for x in range(50)]]), "x") for i in range(-40, 200)]
    old = spark.createDataFrame([(b"k%d" % i, "", 0) for i in range(20)], EARLIER)
    df = spark.createDataFrame(new, INCOMING)
    assert rows(seen.seen_before(old, df, "key", "arrival_id", batches=4)) == rows(seen.seen_before(old, df, "key", "arrival_id"))
    assert seen.seen_before(old, df.where("false"), "key", "arrival_id", batches=4).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_differencing_accounts_for_every_item(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, rng.integers(1, 60))
    for k in (1, 2, 5, 100):
        window, sums = pack.differencing(sizes, k)
        assert window.min() >= 0 and len(sums) <= k
        assert np.bincount(window, weights=sizes, minlength=len(sums)).tolist() == sums.tolist()


def test_differencing_balances():
    assert sorted(pack.differencing(np.array([8, 7, 6, 5, 4]), 2)[1]) == [14, 16]  # the known result of the method
    sums = pack.differencing(np.random.default_rng(0).integers(1, 500, 3000), 40)[1]
    assert sums.max() - sums.min() <= 5


@pytest.mark.parametrize("seed", range(6))
def test_fill_keeps_to_the_capacity(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 300)
    window = pack.fill(sizes, 100)
    used = np.bincount(window, weights=sizes)
    assert used.max() <= 100 and (used > 0).all()
    first_fit = []
    for s in sorted(sizes, reverse=True):
        spot = next((i for i, x in enumerate(first_fit) if x + s <= 100), None)
        first_fit.append(s) if spot is None else first_fit.__setitem__(spot, first_fit[spot] + s)
    assert len(used) <= 1.12 * len(first_fit)


@pytest.mark.parametrize("low", [230, 200])
def test_fill_searches_what_a_rise_passed_over(low):
    sizes = np.random.default_rng(low).integers(low, 231, 1500)
    assert len(np.bincount(pack.fill(sizes, 512))) == 750  # two texts a window


def test_fill_ends_one_above_a_count_that_does_not_fit():
    rng = np.random.default_rng(7)
    for _ in range(20):
        sizes = np.concatenate([rng.integers(1, 513, 200), np.full(100, rng.integers(150, 257))])
        k = len(np.bincount(pack.fill(sizes, 512)))
        least = max(-(-int(sizes.sum()) // 512), int((sizes * 2 > 512).sum()))
        assert k == least or pack.differencing(sizes, k - 1)[1].max() > 512


def test_no_smaller_count_fits():
    rng = np.random.default_rng(1)
    for t in range(120):
        m = int(rng.integers(5, 300))
        sizes = [rng.integers(1, 100, m), np.minimum(rng.lognormal(3, 1, m).astype(int) + 1, 100), rng.choice([23, 46, 47, 20], m), rng.integers(20, 60, m)][t % 4]
        used = int(pack.fill(sizes, 100).max()) + 1
        least = max(-(-int(sizes.sum()) // 100), int((sizes * 2 > 100).sum()), 1)
        assert all(pack.differencing(sizes, k)[1].max() > 100 for k in range(least, used))


def test_differencing_merges_the_two_with_the_largest_spread():
    def plain(sizes, k):
        parts = [sorted([s] + [0] * (k - 1)) for s in sizes]
        while len(parts) > 1:
            parts.sort(key=lambda p: p[0] - p[-1])
            parts = [sorted(x + y for x, y in zip(parts[0], parts[1][::-1])), *parts[2:]]
        return [x for x in parts[0] if x]

    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 7, 20, 60):
        sizes = rng.choice(10**9, 50, replace=False) + 1  # no ties
        window, sums = pack.differencing(sizes, k)
        assert sorted(sums) == plain(sizes.tolist(), k) and (np.bincount(window, weights=sizes) == sums).all()


def test_containers_listed_twice_and_alike(spark):
    df = spark.createDataFrame([(i, 40) for i in range(10)], "doc_id long, tokens long")
    got = pack.pack(df, "doc_id", "tokens", [(1, 100), (1, 100), (2, 100), (1, 50)]).groupBy("container_id", "window").agg(F.count("*").alias("n")).collect()
    assert sorted((r.container_id, r.n) for r in got if r.n == 2) == [(2, 2)] * 5
    assert sum(r.n for r in got if r.container_id == 1) == 20
    many = pack.pack(df, "doc_id", "tokens", {i: 40 + i for i in range(1500)})
    assert many.groupBy("container_id").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (10, 10, 1500)


def test_pack_divides_only_what_is_larger(spark):
    items = [(i, n) for i, n in enumerate([None, 0, 1, 99, 100, 101, 350, -5, 7, 7, 7])] + [(None, 3), (2, 4)]
    df = spark.createDataFrame([(*x, "clash") for x in items], "item long, tokens int, shard string")
    got = pack.pack(df, "item", "tokens", {1: 100, 2: 1000}, shards=2)
    for c, cap in ((1, 100), (2, 1000)):
        one = [r for r in got.collect() if r.container_id == c]
        used = {}
        for r in one:
            used[r.window] = used.get(r.window, 0) + r.tokens
        assert max(used.values()) <= cap
        assert sum(r.tokens for r in one) == sum(max(0, n or 0) for _, n in items)
        pieces = sorted(r.piece for r in one if r["item"] == 6)
        assert pieces == (list(range(4)) if c == 1 else [0])
        assert {r["item"] for r in one} == {i for i, _ in items} and len([r for r in one if r["item"] == 2]) == 2
        assert len([r for r in one if r["item"] == 4]) == 1
    assert pack.pack(df.where("false"), "item", "tokens", {1: 100}).count() == 0 == pack.pack(df, "item", "tokens", {}).count()
    with pytest.raises(ValueError):
        pack.pack(df, "item", "tokens", {1: 0})


def test_token_counts(spark):
    texts = [None, "", " ", "Hello world", "<|endoftext|>", "東京" * 3000, "a" * 200_000]
    got = {r.i: r.tokens for r in pack.count_tokens(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, text string, t string"), "text").collect()}
    enc = pack.encoding(pack.TOKENIZERS, pack.VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert got[3] == 2 and got[4] > 1


# --- leaks -----------------------------------------------------------------------------------------------------------


def plain_leaks(docs, items, run):
    grams = {}
    for i, t in items:
        n = leak.normalise(t)
        for p in range(len(n) - run + 1):
            grams.setdefault(n[p : p + run], set()).add(i)
    out = set()
    for d, t in docs:
        n = leak.normalise(t)
        for p in range(len(n) - run + 1):
            out |= {(i, d) for i in grams.get(n[p : p + run], ())}
    return sorted(out, key=repr)


@pytest.mark.parametrize("run, passes", [(40, 4_000_000), (8, 50), (12, 4_000_000)])
def test_leaks_brute_force(spark, monkeypatch, run, passes):
    monkeypatch.setattr(leak, "PASS_CHARS", passes)
    rnd = random.Random(run)
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word(rnd.choice(["ab", "abcdé", "東京都", "กข๑", "\U0001d7ce\U00020000"])) for _ in range(n))
    items = [(i, text(rnd.randrange(1, 30))) for i in range(40)] + [(100, None), (101, ""), (102, "short"), (103, "aaaaaaaaaaaaaaa" * 9)]
    items.append((104, items[0][1]))
    docs = []
    for d in range(300):
        parts = [text(5)]
        for _ in range(rnd.randrange(3)):
            t = rnd.choice(items)[1] or ""
            a = rnd.randrange(len(t) + 1)
            piece = t[a : a + rnd.choice([run - 1, run, run + 1, 200])]
            parts += [rnd.choice([piece, piece.upper(), unicodedata.normalize("NFD", piece), "-".join(piece)]), text(2)]
        docs.append((1000 + d, rnd.choice([" ", "", "\n"]).join(parts)))
    docs += [(5000, None), (5001, ""), (5002, "a" * 3000), (5003, text(4000) + items[3][1] + text(4000)), (None, items[3][1])]
    frame = lambda x, n: spark.createDataFrame([(*r, "clash") for r in x], f"{n} long, text string, d string")
    got = leak.find_leaks(frame(docs, "doc_id"), frame(items, "item_id"), run=run)
    assert rows(got) == plain_leaks([d for d in docs if d[0] is not None], items, run)
    assert len(rows(got)) > 15


def test_chunks_common_to_many_items_cost_no_pairs():
    import time
    import tracemalloc

    rnd = random.Random(3)
    some = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    head = some(20)
    texts = [head + some(45) for _ in range(5000)] + [some(20) + head + some(20)]
    patterns = leak.Patterns([[i] for i in range(len(texts))], texts)
    doc = "".join(head + "xyz" for _ in range(3000))
    tracemalloc.start()
    began = time.time()
    assert patterns.search([7], [doc]) == set()
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 2 and peak < 50e6
    assert patterns.search([7, 8], [doc + texts[17] + doc, texts[-1][:40]]) == {(17, 7), (5000, 8)}
    shared = some(60)
    many = leak.Patterns([[i, -i] for i in range(1, 3000)], [shared + some(5) for _ in range(1, 3000)])
    assert len(many.search([1], [shared * 500])) == 2 * 2999


def test_windows_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(leak.Patterns, "window_hashes", lambda self, text, at: (text[at] % 2).astype("uint64"))
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc") for _ in range(30)) for _ in range(20)]
    docs = [rnd.choice(texts)[: rnd.randrange(30)] + "".join(rnd.choice("abc") for _ in range(30)) for _ in range(40)]
    got = leak.Patterns([[i] for i in range(20)], texts, 8).search(list(range(40)), docs)
    assert sorted(got, key=repr) == plain_leaks(list(enumerate(docs)), list(enumerate(texts)), 8)


def test_repeated_ids_of_items_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(leak, "PASS_CHARS", 50)
    docs = spark.createDataFrame([(1, "x" * 50 + "y" * 50), (1, "x" * 60)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "x" * 45), (5, "y" * 45), (5, "x" * 45), (6, "x" * 45)], "item_id long, text string")
    assert rows(leak.find_leaks(docs, items)) == [(5, 1), (6, 1)]


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leak.find_leaks(docs, items).count() == 0
    assert leak.find_leaks(docs.where("false"), items.unionByName(docs.select(F.col("doc_id").alias("item_id"), "text"))).count() == 0
    with pytest.raises(ValueError):
        leak.find_leaks(docs, items, run=41)


# --- sentences -------------------------------------------------------------------------------------------------------

UNITS = [
    ["Mr. J. K. Yarrow met Dr. Lunde at 4.05 p.m. in St. Dorn.", "It rose to 34,557.99 (see p. 5; cf. the note) a year!", "Why?!", "Shame."],
    ["She asked, “Who signed? Who paid?” and left.", "“We never agreed. We never will,” said the hon. member.", "I quote: “It stays shut.”", "They said “No.” twice."],
    ["Pumps, pipes, etc.", "The board of Vell & Co.", "It was neither he nor I.", "von Krom objected at once.", "7 letters came in Jan. and Feb. alone."],
    ["We waited ... and waited.", "I thank him for that…", "(Applause.)", "The price (Interruption.) rose.", "[Laughter]", "12. The first charge, dated 3.4.2025, is withdrawn."],
    ["Der 3. Ausschuss tagte am 19. Mai bis 8.30 Uhr und z. B. nach Art. 5 Abs. 2 für ca. 3,1 Mio. Kronen.", "Sie rief: „Hört endlich zu!“", "Die Busse usw.", "»Warum jetzt? Warum hier?«, fragte man.", "Das gilt i. d. F. vom 7.11.2023.", "Wer zahlt das?"],
    ["C’est une honte !", "« Assez ! » a crié quelqu’un de Dorn.", "M. Lunde et Mme Krom citent l’art. 5, p. ex. sur le plan.", "La séance est levée à 6 h 30.", "Le Pr. Vell est venu.", "On attend... et on attend."],
    ["¿Quién paga?", "«¡Basta!», gritó alguien.", "El Sr. Krom y la Dra. Vell citaron el art. 9, pág. 4.", "Asistieron a las 4.30 h.", "Dijo: \"La puerta. Cerrada.\"", "¡Qué vergüenza!"],
]
WIDE = [
    ["「もう十分だ。」", "北君は「変わらない。変えない。」と述べました。", "これは、（資料。）数字です。", "何だ！？", "待って……また待って、来ない。", "No.7の資料、vol.2です。", "（拍手）"],
    ["他问：「为什么？为什么？」然后坐下。", "议员说：“没变。不会变。”", "“够了！”有人喊道。", "《渡轮。夜车》一书。", "他说：“谁？”随后离席……", "我们等……一直等。", "参见 Dr. Krom 的报告（vol. 2）。"],
]
SPACED = [
    ["ข้อ 2.4 ของ ร่าง พ.ร.บ. ยังไม่ผ่านค่ะ", "มีเรือ รถไฟ ฯลฯ ไม่พอครับ", "ท่านถามว่า “ใครเซ็น” แล้วก็เงียบไปค่ะ", "(ปรบมือ)", "จริงหรือคะ"],
    ["श्री जे. के. लुंडेकर ने धारा 9 पढ़ी।", "यह सच है... पर अधूरा है |", "“बस!” किसी ने पुकारा।", "डॉ. वेलकर ने कहा, “कुछ नहीं। कुछ नहीं।” और बैठ गए ।", "पैसा कौन देगा?"],
]


def cut(text):
    out, at = [], 0
    for e in sentences.unit_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize("units, joint", [(u, " ") for u in UNITS + SPACED] + [(u, "\n") for u in UNITS + SPACED] + [(u, "") for u in WIDE] + [(u, "  ") for u in UNITS])
def test_units(units, joint):
    assert cut(joint.join(units)) == units


def test_paragraphs_headings_and_speakers():
    text = " \n\nOral Questions — pumps\n\nMrs. Ann V. Krom (HU):\nThe price rose.\nIt fell\nDr. Vell:\nNo stop here\n \n(Applause.)\nA line that is\nbroken. Next?On we go."
    want = ["Oral Questions — pumps", "Mrs. Ann V. Krom (HU):", "The price rose.", "It fell", "Dr. Vell:", "No stop here", "(Applause.)", "A line that is\nbroken.", "Next?", "On we go."]
    assert cut(text) == want
    assert cut("TOP 6. Aussprache\n\nVizepräsidentin Krom:\nDas ist der Punkt.") == ["TOP 6. Aussprache", "Vizepräsidentin Krom:", "Das ist der Punkt."]
    assert cut("(Zuruf: Nein!) Zum zweiten Punkt:\ndie Opposition lehnt das ab.") == ["(Zuruf: Nein!)", "Zum zweiten Punkt:\ndie Opposition lehnt das ab."]


def test_blanks_missing_and_passages_in_other_scripts():
    assert cut("I know well.von Krom objected.The end etc.Next at 5 p.m.(Applause.)Show 4.5.2025.Mrs. Vell, vol.2, H.W.C. board.") == ["I know well.", "von Krom objected.", "The end etc.", "Next at 5 p.m.", "(Applause.)", "Show 4.5.2025.", "Mrs. Vell, vol.2, H.W.C. board."]
    assert cut("予算は55.\n2億円です。次に、政府は灯台の費用を説明しておりません。委員会は修正を認めません。Ein Würfel wiegt 5 Gramm in Öl.(Beifall.)\nWie viel wiegt er?次に、Dr. Krom です。") == ["予算は55.\n2億円です。", "次に、政府は灯台の費用を説明しておりません。", "委員会は修正を認めません。", "Ein Würfel wiegt 5 Gramm in Öl.", "(Beifall.)", "Wie viel wiegt er?", "次に、Dr. Krom です。"]
    assert cut("मुद्दा है| One paper: “It fell. So.”. दूसरी बात यह है।") == ["मुद्दा है|", "One paper: “It fell. So.”.", "दूसरी बात यह है।"]


def test_speaker_lines_of_any_length():
    long = "Mrs. Ann V. Krom, Minister for Harbours, Fisheries and Night Trains, on behalf of the Works Committee of Vell and Dorn (HU):"
    assert cut(f"{long}\nThe price rose.") == [long, "The price rose."]
    assert cut(f"The price rose.\nIt fell\n{long}\nNobody pays.") == ["The price rose.", "It fell", long, "Nobody pays."]
    full = "This government asked the committee of Lemape to publish what it knows and"
    assert cut(f"{full}\nMrs. Ann Yarrow-Krom, Minister for Harbours and Fisheries (HU):\nNobody pays.") == [full, "Mrs. Ann Yarrow-Krom, Minister for Harbours and Fisheries (HU):", "Nobody pays."]


@pytest.mark.parametrize("text", ["This government asked the committee of Lemape to publish what\nGakeda wrote last year:\nthe price rose.", "Frankly, this government set aside 25.3 million crowns (An hon. member:\nShame!) for pumps.", "On the second question before us:\nthe committee cannot accept it."])
def test_wrapped_text_is_no_speaker_line(text):
    assert cut(text + " It fell.") == [text, "It fell."]


ITEMS = [
    ["(1) The fee rises.", "(2) It falls.", "(Applause.)", "(a) The rate stays.", "[3] Nobody pays.", "(iv) It ends.", "(12a) It is void."],
    ["2.1. The fee rises.", "2.1.1. It falls.", "IV. The fee stays.", "II.) Nobody pays.", "1a. It ends.", "§ 5. It is void.", "– (b). It is late."],
    ["(1) (a) The fee rises.", "1. IV. It falls.", "I. The price rose so.", "2.2.The blank is missing."],
    ["(१) यह सच है।", "(क) पैसा नहीं है।"],
    ["⑩. The fee rises.", "ⅰ. It falls.", "ⅱ It stays.", "ⓐ It ends.", "(Ⅳ) It is void."],
]


@pytest.mark.parametrize("units, joint", [(u, j) for u in ITEMS for j in (" ", "\n", "\n\n")] + [(["（１）予算です。", "（一）資料です。", "（ア）数字です。", "1．道です。", "（笑）", "次です。"], "")])
def test_item_numbers_belong_to_their_sentences(units, joint):
    assert cut(joint.join(units)) == units


def test_list_levels_tell_numbers_from_words():
    assert cut("(xlviii) One. (xlix) Two. (l) Three. (a) Four. (li) Five. (mix) Six.") == ["(xlviii) One.", "(xlix) Two.", "(l) Three.", "(a) Four.", "(li) Five.", "(mix)", "Six."]
    assert cut("(l) One. (li) Two.") == ["(l) One.", "(li) Two."]
    assert cut("(xxxix) One. (a) Two. (xl) Three. (b) Four.") == ["(xxxix) One.", "(a) Two.", "(xl) Three.", "(b) Four."]
    assert cut("XXXIX. One.\n\nXL. Two. (2025) Three. MIX. Four.") == ["XXXIX. One.", "XL. Two.", "(2025)", "Three.", "MIX.", "Four."]
    assert cut("(h) One. (i) Two. (1) In. (j) Three. (ii) Four.") == ["(h) One.", "(i) Two.", "(1) In.", "(j) Three.", "(ii) Four."]
    assert cut("(999) One. (1000) Two.") == ["(999) One.", "(1000) Two."]
    assert cut(f"({'1' * 9000}) One. {'2' * 9000}. Two.") == [f"({'1' * 9000})", "One.", f"{'2' * 9000}. Two."]
    assert cut("It rose to\n(1) a point (2) and fell, under 112(b) too. (Laughter.) So be it.") == ["It rose to\n(1) a point (2) and fell, under 112(b) too.", "(Laughter.)", "So be it."]


@pytest.mark.parametrize("text", ["", " ", "\n\n", " \t", None])
def test_blank_texts_have_no_unit(text):
    assert sentences.unit_ends(text) == []


@pytest.mark.parametrize("text", ["“never closed. Two. “Three.", "closed) never. “Odd ” marks” (here. ] and [there.", "....", "?!?!", "\"", "’’’", "（「", "a.b.c.", "|||", "Hi.\r\n\r\nThere."])
def test_units_cover_any_text(text):
    ends = sentences.unit_ends(text)
    assert ends == sorted(set(ends)) and ends[-1] == len(text.rstrip())
    at = 0
    for e in ends:
        assert text[at:e].strip() and not text[e - 1].isspace()
        at = e


def test_random_texts_are_covered():
    rnd = random.Random(5)
    marks = list(".!?…。！？।|“”„«»‘’「」\"()[]（）《》\n\n\n  :：ab漢ครับ1 ") + ["\n\n", "Dr.", "z. B.", "von Ab", "A", "B"]
    for _ in range(1500):
        text = "".join(rnd.choice(marks) for _ in range(rnd.randrange(80)))
        ends, at = sentences.unit_ends(text), 0
        assert ends == sorted(set(ends))
        for e in ends:
            assert text[at:e].strip() and not text[e - 1].isspace() and "\n\n" not in text[at:e].strip()
            at = e
        assert not text[at:].strip()


def test_long_texts_take_linear_time(spark):
    import time

    took = []
    for n in (2000, 16000):
        text = "It rose (see p. 5) to “4.5. No.” again. " * n
        began = time.time()
        assert len(sentences.unit_ends(text)) == n
        took.append(time.time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


@pytest.mark.parametrize("units", [
    ["ሰላም ለዓለም።", "ይህ ሁለተኛ ነው።"], ["នេះជាប្រយោគ។", "នេះជាទីពីរ៕"], ["ဒါက ပထမ၊ ဒုတိယ။", "ဒါက တတိယ။"], ["Սա առաջինն է։", "Սա երկրորդն է։"], ["བོད་ཡིག།", "གཉིས་པ།"], ["یہ پہلا ہے۔", "یہ دوسرا ہے۔"], ["ᠨᠢᠭᠡ᠃", "ᠬᠣᠶᠠᠷ᠃"],
    ["Col. Smith and Adm. Jones met Maj. Vell.", "The U.S. Senate sat in column 5.", "It left the U.S.", "The rest stayed."],
    ["Он живёт на ул. Ленина.", "Проф. Иванов и т.д. ушли.", "Всё."], ["Der Preis stieg bspw. Montag.", "Dhr. Jansen zweeg.", "Sig. Rossi parlò."],
])
def test_units_of_other_scripts_and_abbreviations(units):
    assert cut(" ".join(units)) == units


def test_unmatched_brackets_take_linear_time():
    import time

    began = time.time()
    for text in ("(" * 20_000 + "]" * 20_000, "([{“" * 10_000 + "x. Y." + ")" * 10_000, "x " + "”)" * 20_000):
        assert sentences.unit_ends(text)[-1] == len(text)
    assert time.time() - began < 3


@pytest.mark.parametrize("piece", ["1.", "a.", "A.B-"])
def test_long_words_with_stops_are_followed_once(piece):
    import time

    began = time.time()
    assert sentences.unit_ends(piece * 10_000)[-1] == len(piece) * 10_000
    assert time.time() - began < 30


def test_scripts_and_speakers_across_long_gaps():
    gap = " " * 200
    assert cut(f"It rose{gap}\n{gap}Mrs. Ann Krom:{gap}\nNo.") == ["It rose", "Mrs. Ann Krom:", "No."]
    digits = "5" * 300
    assert cut(f"यह सच है {digits}| One.") == [f"यह सच है {digits}|", "One."]
    assert cut(f"A “cat” {digits}| One.") == [f"A “cat” {digits}| One."]


def test_units_with_their_text(spark):
    df = spark.createDataFrame([(1, " A cat.\n\n(Applause.) B", "x"), (2, None, "y"), (3, " ", "z"), (None, "One.", "q")], "doc_id long, text string, unit string")
    assert rows(sentences.sentence_units(df)) == sorted([(1, 1, 7, "A cat."), (1, 9, 20, "(Applause.)"), (1, 21, 22, "B"), (None, 0, 4, "One.")], key=repr)
    assert sentences.sentence_units(df.where("false")).count() == 0


def test_split_table(spark):
    df = spark.createDataFrame([(1, "A cat. A dog.", "x"), (None, "One.", "x"), (3, None, "x"), (4, "  ", "x"), (1, "A cat. A dog.", "x")], "doc_id long, text string, end_char string")
    assert rows(sentences.split_sentences(df)) == sorted([(1, 6), (1, 13), (1, 6), (1, 13), (None, 4)], key=repr)
    assert sentences.split_sentences(df.where("false")).count() == 0
