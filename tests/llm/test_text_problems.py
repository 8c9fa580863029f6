"""Conversations, splitting, encoding, leaks and spam."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import conversations, leaks, shingles, spam, splitting, tokens

MESSAGE = "id string, session_id string, role string, content string, created_at string, received_at timestamp"


def chat(spark, rows):
    """Rows (id, session, role, content, created_at); received in the order given."""
    rows = [(*r, None) for r in rows]
    df = spark.createDataFrame(rows, MESSAGE)
    return df.withColumn("received_at", F.timestamp_micros(F.monotonically_increasing_id() * 1_000_000))


def sessions(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def whole(spark, rows, *ids):
    found = conversations.whole_conversations(chat(spark, rows).coalesce(1), sessions(spark, *ids))
    return sorted((r.session_id, r.turn_no, r.message_id) for r in found.collect())


T = "2024-01-01T0{}:00:00"


def test_whole_conversation_over_several_hours(spark):
    rows = [("c", "S1 ", "User", "q2", T.format(3)), ("a", " s1", "user", "q", T.format(1)), ("s", "s1", "SYSTEM", "be", T.format(1)), ("b", "s1", "assistant", "r", T.format(1) + "+00:00"), ("d", "s1", " assistant", "r2", "2024-01-01 05:00:00+02:00")]
    assert whole(spark, rows, "s1") == [("s1", 1, "s"), ("s1", 2, "a"), ("s1", 3, "b"), ("s1", 4, "c"), ("s1", 5, "d")]


@pytest.mark.parametrize(
    "broken",
    [
        [("a", "s", "user", "q", T.format(1))],  # no reply
        [("a", "s", "assistant", "q", T.format(1))],
        [("a", "s", "user", "q", T.format(1)), ("b", "s", "user", "q", T.format(2)), ("c", "s", "assistant", "r", T.format(3))],
        [("a", "s", "user", "q", T.format(1)), ("b", "s", "assistant", " \n ", T.format(2))],  # blank
        [("a", "s", "user", "q", T.format(1)), ("b", "s", "assistant", None, T.format(2))],
        [("a", "s", "user", "q", "pending"), ("b", "s", "assistant", "r", T.format(2))],
        [("a", "s", "user", "q", "0000-00-00T00:00:00"), ("b", "s", "assistant", "r", T.format(2))],
        [("a", "s", "human?", "q", T.format(1)), ("b", "s", "assistant", "r", T.format(2))],
        [("a", "s", None, "q", T.format(1)), ("b", "s", "assistant", "r", T.format(2))],
        [("a", "s", "user", "q", T.format(1)), ("x", "s", "system", "late", T.format(2)), ("b", "s", "assistant", "r", T.format(3))],
        [("x", "s", "system", "1", T.format(0)), ("y", "s", "system", "2", T.format(0)), ("a", "s", "user", "q", T.format(1)), ("b", "s", "assistant", "r", T.format(3))],
        [("a", "t", "user", "q", T.format(1)), ("b", "t", "assistant", "r", T.format(2))],  # unknown session
        [("a", None, "user", "q", T.format(1)), ("b", None, "assistant", "r", T.format(2))],
    ],
)
def test_broken_conversations(spark, broken):
    good = [("g1", "ok", "user", "q", T.format(1)), ("g2", "ok", "assistant", "r", T.format(2))]
    assert whole(spark, broken + good, "s", "ok", "empty") == [("ok", 1, "g1"), ("ok", 2, "g2")]


def test_resent_rows_and_empty_tables(spark):
    rows = [("a", "s", "user", "", T.format(1)), ("b", "s", "assistant", "r", T.format(2)), ("a", "s", "user", "q", T.format(1)), ("b", "s", "assistant", "r", T.format(2))]
    assert whole(spark, rows, "s", "s") == [("s", 1, "a"), ("s", 2, "b")]
    assert whole(spark, [("a", "s", "user", "q", T.format(1))] and [(None, None, None, None, None)], "s") == []
    assert conversations.whole_conversations(spark.createDataFrame([], MESSAGE), sessions(spark, "s")).count() == 0


@pytest.mark.parametrize("value,instant", [("2024-01-01T00:00:00Z", 0), ("2024-01-01 00:00:00.5", 500_000), ("2024-01-01T01:00:00+0100", 0), ("2023-12-31T16:00:00-08:00", 0), ("2024-01-01", None), ("x", None), (None, None), ("2024-13-01T00:00:00", None)])
def test_instants(spark, value, instant):
    got = spark.createDataFrame([(value,)], "c string").select(F.unix_micros(conversations.instant(F.col("c")))).first()[0]
    assert (got and got - 1704067200_000_000) == instant if instant else got in (None, 1704067200_000_000) and (got is None) == (instant is None)


def text_of(rng):
    out = ""
    while len(out) < rng.randint(0, 6000):
        out += rng.choice(["word", "a", "x" * 700, "Zürich", "🧠", "!", "?", "."]) + rng.choice([" ", "\n", "\n\n", "\t", ". ", "", "  "])
    return out


def slow_pieces(t):
    """The statement of TESTDATA.md, word for word."""
    white, s, out = " \t\n", 0, []
    while True:
        if len(t) - s <= 1200:
            return [*out, (s, len(t))]
        ends = range(s + 601, s + 1201)
        e = max((e for e in ends if t[e - 2 : e] == "\n\n"), default=0) or max((e for e in ends if t[e - 1] in white and t[e - 2] in ".!?"), default=0) or max((e for e in ends if t[e - 1] in white), default=0) or s + 1200
        out.append((s, e))
        s = next((p for p in range(e - 150, e) if t[p - 1] in white and t[p] not in white), e - 150)


def test_longest_pieces_equal_the_statement():
    rng = random.Random(5)
    for _ in range(300):
        t = text_of(rng)
        assert splitting.longest(t) == slow_pieces(t)


def test_balanced_pieces():
    rng = random.Random(6)
    for t in [text_of(rng) for _ in range(300)] + ["x" * 50_000, "", "a" * 1200, "a " * 601]:
        found = splitting.balanced(t)
        assert found[0][0] == 0 and found[-1][1] == len(t) and all(e - s <= 1200 for s, e in found)
        assert all(a < c <= b < d for (a, b), (c, d) in zip(found, found[1:]))
        if len(found) > 1:
            assert min(e - s for s, e in found) > 200


def test_pieces_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 1200), (4, "y" * 1201), (4, "y" * 1201)], "k long, text string").withColumn("piece_no", F.lit(9)).withColumn("__text", F.lit(""))
    got = sorted(tuple(r) for r in splitting.pieces(df.drop("__text"), ["k"], "text").collect())
    assert got == [(4, 1, 0, 1200)] * 2 + [(4, 2, 1050, 1201)] * 2
    assert splitting.pieces(df.limit(0), ["k"], "text").count() == 0


def test_sections(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [("t", None), (None, "x" * 1300)])], "k long, s array<struct<title:string,text:string>>")
    s = splitting.sections(df, "k", "s")
    assert s.count() == 2 and splitting.pieces(s, ["k", "section_no"], "text").count() == 2


TRICKY = ["", None, " ", "  a  b ", "it's I'LL", "<|endoftext|> x", "日本語 🧠", "a\r\n\tb", "x" * 20_000, "½ ² Ⅷ ٣", "\x00\x1c\x85​ ", "end ", "\n\n\n", "á é", "ﬁne", "one  two", "tab\there", "a \n b"]


def test_ids_equal_two_other_libraries():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    codec = tokens.Codec(tokens.sentencepiece_model(tokens.load_pieces(tokens.VOCABULARY)))
    other = Tokenizer.from_file(tokens.VOCABULARY)
    other.encode_special_tokens = True
    with open(tokens.VOCABULARY.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    third = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = TRICKY + ["".join(rng.choice([t for t in TRICKY if t and len(t) < 50]) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids == other.encode(t or "", add_special_tokens=False).ids
        assert codec.decode(ids) == (t or "")
        if t and not any(c in t for c in "\x1c\x85"):
            assert ids == third.encode_ordinary(t)


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    got = sorted((r.key, list(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[3][1]) == 2
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, words(rng.randint(0, 16))) for i in range(8)] + [(8, None), (9, "")]
    docs = [(i, words(rng.randint(0, 40)).upper().replace(" ", "-")) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    expected = set()
    for d, t in docs:
        w = shingles.words(t or "")
        for i, x in items:
            v = shingles.words(x or "")
            if any(w[j : j + 5] == v[k : k + 5] for k in range(len(v) - 4) for j in range(len(w) - 4)):
                expected.add((d, i))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string")
    for limit, scan in ((500_000, 8), (30, 8), (20, 1)):  # one automaton, several, and several scans
        monkeypatch.setattr(leaks, "AUTOMATON_WORDS", limit)
        monkeypatch.setattr(leaks, "SCAN_AUTOMATA", scan)
        got = {tuple(r) for r in leaks.leaked(d.drop("item_id"), "doc_id", "text", i, "item_id", "text", 5).collect()}
        assert got == expected and expected
    assert leaks.leaked(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert leaks.leaked(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def test_cleaned_texts(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rest = " ".join(f"r{i}" for i in range(30))
    docs = [(1, f"{rest}, {passage}! {rest}"), (2, passage), (3, rest), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in leaks.cleaned(d, "doc_id", "text", spark.createDataFrame([(7, passage)], "item_id long, text string"), "item_id", "text").collect()}
    assert got[1].text == f"{rest}, ! {rest}" and got[1].spans == 1 and got[1].leaked_words == 12
    assert got[2].dropped and got[2].text is None
    assert got[3].text == rest and got[4].text is None and not got[4].dropped and got[5].text == ""


def test_cleaning_depends_neither_on_automata_nor_on_scans(spark, monkeypatch):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    b = b.replace(" b6 ", f" {a} b6 ")  # a stands within b; without it b's halves would meet
    rest = " ".join(f"r{i}" for i in range(60))
    inside = " ".join(f"b{i}" for i in range(6)), " ".join(f"b{i}" for i in range(6, 12))
    docs = spark.createDataFrame([(1, f"{rest} {inside[0]} {a} {inside[1]} {rest}"), (2, f"{rest} {b} {rest}"), (3, f"{rest} {a}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, a), (2, " ".join(inside)), (3, b)], "item_id long, text string")
    found = []
    for limit, scan in ((500_000, 8), (1, 8), (1, 1)):
        monkeypatch.setattr(leaks, "AUTOMATON_WORDS", limit)
        monkeypatch.setattr(leaks, "SCAN_AUTOMATA", scan)
        found.append(sorted(tuple(r) for r in leaks.cleaned(docs, "doc_id", "text", items, "item_id", "text").collect()))
    assert found[0] == found[1] == found[2]
    assert [r[1:5] for r in found[0]] == [(1, 24, 144, False), (1, 24, 144, False), (1, 12, 72, False)]


def test_lower_casing_that_lengthens_a_text(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rest = "İstanbul Σας " + " ".join(f"r{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{rest} {passage}, {rest}")], "doc_id long, text string")
    got = leaks.cleaned(docs, "doc_id", "text", spark.createDataFrame([(7, passage.upper())], "item_id long, text string"), "item_id", "text").first()
    assert (got.spans, got.leaked_words, got.dropped, got.text) == (1, 12, False, f"{rest} , {rest}")
    for t in ("İİ aİb ß", "abc Def", "x\u0130", ""):
        assert len(shingles.places(t)) == len(shingles.words(t))


PROSE = "The narrator would rather shorten a quiet chord than delay the scale. Most of the rest settles slowly, although one motif, a reed and a drum explain it. "
SPAM = {
    "list": ", ".join(f"{a} oak bench {b}" for a in ("cheap", "best", "buy") for b in ("sale", "deal", "shop", "kit")),
    "run": " ".join(f"Oak Bench {b} Pine Table {b}" for b in ("Sale", "Deal", "Online", "Kit", "Offer", "2025", "Best")),
    "lower run": " ".join(f"oak bench {b}" for b in ("fenwick", "norvale", "estbrook", "wenhaven", "torwick", "rilbrook", "marmont")),
    "forced": "Get oak bench today, oak bench deals, oak bench offers and more oak bench. Our oak bench is the best oak bench for every oak bench fan. With oak bench you get oak bench, because oak bench means oak bench.",
    "links": "\n".join(f"https://x{i}.example/oak-bench?ref={i}" for i in range(9)),
    "anchors": "\n".join(f'<a href="http://x{i}.example/a">oak bench {i}</a><br>' for i in range(9)),
    "markdown links": "\n".join(f"* [oak bench {i}](http://x{i}.example/a)" for i in range(9)),
    "tags": " ".join(f"#oak_bench_{i}" for i in range(20)),
    "products": "\n".join(f"oak bench | red | SKU {i}4 | {i}.95 | in stock" for i in range(9)),
    "lines": "\n".join(f"oak bench {b}" for b in ("guide", "", "tips", "", "notes", "course", "basics", "")),
}
CLEAN = {
    "prose": PROSE * 4,
    "linked prose": (PROSE + "(see https://a.example/1) ") * 4,
    "code": "def oak(bench, n=3):\n    if bench > 4: return oak_bench\n# move the oak before bench\n    for x in bench.oaks:\n" * 5,
    "table": "| Step | What it does |\n|---|---|\n" + "".join(f"| oak bench | After {i} minutes the class moved the oak bench by hand. |\n" for i in range(6)),
    "reading list": "\n".join(f"- [oak bench](https://a.example/{i}) {PROSE}" for i in range(5)),
    "steps": "\n".join(f"{i}. {PROSE}" for i in range(1, 6)),
    "transcript": (PROSE * 6).lower().replace(".", "").replace(",", ""),
    "glossary": "\n".join(f"oak {w}: {PROSE}" for w in ("bench", "table", "chair", "door")),
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert spam.spam_share(SPAM[name] * (1 if len(SPAM[name]) > 200 else 2))[0] > 0.5
    mostly_prose = PROSE * (2 * len(SPAM[name]) // len(PROSE) + 2) + "\n\n" + SPAM[name]
    assert spam.spam_share(mostly_prose)[0] <= 0.5


@pytest.mark.parametrize("name", CLEAN)
def test_no_spam(name):
    assert spam.spam_share(CLEAN[name])[0] <= 0.5


def test_spam_rows(spark):
    rows = [(1, SPAM["links"]), (1, SPAM["links"]), (2, PROSE), (3, None), (4, " \n"), (5, ""), (6, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("share", F.lit(1))
    assert [r.key for r in spam.flagged(df, "doc_id", "text").collect()] == [1]
    assert spam.shares(df, "doc_id", "text").count() == 7
    assert spam.flagged(df.limit(0), "doc_id", "text").count() == 0


def test_spam_of_many_keywords_in_running_text():
    keywords = ("oak bench", "pine table", "elm chair", "ash shelf", "fir stool", "yew desk", "teak bed", "birch lamp")
    assert spam.spam_share(" ".join(f"With {k} you get {k}, because {k} means {k}." for k in keywords))[0] == 1
    said_again = " ".join(f"{PROSE} And in the {w} hall it goes on." for w in ("old", "new", "red", "far", "low", "dry"))
    assert spam.spam_share(said_again.lower().replace(".", "").replace(",", ""))[0] <= 0.5


@pytest.mark.parametrize(
    "text",
    [
        "Buy cheap running shoes online today. " * 200,
        "Get the oak bench for your home today. We have a pine table at a fair price. Order an elm chair and save big money now. " * 100,
        "oak bench pine table elm chair ash shelf cheap\n" * 200,
        "Buy cheap running shoes online today. " * 5,
    ],
)
def test_spam_repeated_verbatim(text):
    assert spam.spam_share(text)[0] > 0.5


def test_prose_said_again_is_no_spam():
    assert spam.spam_share(PROSE * 9)[0] <= 0.5
    assert spam.spam_share("Gitara brzmi cicho pod starym dachem, kiedy deszcz pada nad miastem. Nikt nie pyta, skąd muzyka płynie dalej. " * 4)[0] <= 0.5


def test_all_shapes_count():
    """A page of many kinds of link lines, each a small part of it."""
    lines = [f"https://a{i}.example/{i}" for i in range(3)] + [f"SEE HTTPS://B{i}.EXAMPLE NOW" for i in range(3)] + [f"Oak Bench Red Blue Big Small www.c{i}.example" for i in range(3)]
    lines += [f"oak bench red blue big small fair www.d{i}.example" for i in range(3)] + ["#oak #bench #elm"] * 3 + [f"#{a}{i}" for i in range(1) for a in "oak elm ash fir yew teak birch pine beech lime".split()]
    lines += ["oak | red | 4 | 5.95"] * 2 + ["Oak; Red; 4; 5.95; Big"] * 2 + ["oak, red, 4, 5.95, big"] * 2
    share, shapes = spam.spam_share("\n".join(lines))
    assert share > 0.8 and len(shapes) == spam.NAMED


def labelled_pages(seed: int, n: int):
    """(text, whether it's spam): invented pages, spam for 60 to 100 % of their characters, prose with up to 40 % of it, and odd prose."""
    rng = random.Random(seed)
    nouns = "lantern harbour needle orchard violin saddle kettle parlour meadow anvil shutter basket thimble quarry rudder pantry easel furnace".split()
    verbs = "holds lifts carries mends follows answers crosses measures softens gathers".split()
    small = "the a every one some that this his her our".split()
    places = "norwick eastham felden garrow hallby inverlea jarrowby kelmere lunstead marwell oakham penby".split()

    def sentence() -> str:
        words = []
        for _ in range(rng.randint(2, 4)):
            words += [rng.choice(small), rng.choice(nouns), rng.choice(verbs), "when", rng.choice(small), rng.choice(nouns), rng.choice(["waits", "is still", "turns", "comes back"]), rng.choice(["and", "but", "while"])]
        return " ".join(words[:-1]).capitalize() + "."

    def prose(size: int) -> str:
        out: list[str] = []
        while sum(map(len, out)) < size:
            out.append(" ".join(sentence() for _ in range(rng.randint(2, 5))))
        return "\n\n".join(out)

    def spam_part(size: int) -> str:
        key = f"{rng.choice(nouns)} {rng.choice(nouns)}"
        kinds = {
            "keywords": lambda: ", ".join(f"{rng.choice(['cheap', 'best', 'buy', 'top'])} {key} {rng.choice(places)}" for _ in range(8)),
            "forced": lambda: f"Get {key} in {rng.choice(places)}, because {key} means {key} and our {key} is the best {key}.",
            "links": lambda: f"https://{rng.choice(places)}{rng.randint(1, 99)}.example/{key.replace(' ', '-')}",
            "anchors": lambda: f'<a href="http://{rng.choice(places)}.example/{rng.randint(1, 999)}">{key} {rng.choice(places)}</a>',
            "tags": lambda: " ".join(f"#{rng.choice(nouns)}{rng.choice(places)}" for _ in range(8)),
            "products": lambda: f"{key} | {rng.choice(['red', 'blue'])} | SKU {rng.randint(100, 999)} | {rng.randint(1, 90)}.95 | in stock",
        }
        make, out = kinds[rng.choice(sorted(kinds))], []
        while sum(map(len, out)) < size:
            out.append(make())
        return "\n".join(out)

    odd = {
        "steps": lambda: "\n".join(f"{i}. {sentence()}" for i in range(1, 9)),
        "glossary": lambda: "\n".join(f"{rng.choice(nouns)} {rng.choice(nouns)}: {sentence()}" for _ in range(8)),
        "reading": lambda: "\n".join(f"- [{rng.choice(nouns)}](https://{rng.choice(places)}.example/{i}) {sentence()} {sentence()}" for i in range(6)),
        "code": lambda: "\n".join(f"def {rng.choice(nouns)}_{i}({rng.choice(nouns)}):\n    return {rng.choice(nouns)}[{i}]" for i in range(8)),
        "table": lambda: "\n".join(f"| {rng.choice(nouns)} | {sentence()} |" for _ in range(8)),
    }
    for i in range(n):
        size, kind = rng.randint(800, 3000), i % 3
        if kind == 0:
            share = rng.uniform(0.6, 1)
            yield spam_part(int(size * share)) + "\n\n" + (prose(int(size * (1 - share))) if share < 0.95 else ""), True
        elif kind == 1:
            share = rng.uniform(0, 0.35)
            yield prose(int(size * (1 - share))) + ("\n\n" + spam_part(int(size * share)) if share > 0.05 else ""), False
        else:
            yield odd[rng.choice(sorted(odd))](), False


def test_accuracy_on_held_out_pages():
    """Pages of templates and words that the rules weren't set on. README has the figures."""
    right = {(a, b): 0 for a in (True, False) for b in (True, False)}
    for text, truth in labelled_pages(11, 900):
        right[truth, spam.spam_share(text)[0] > spam.DOMINANT] += 1
    recall, precision = right[True, True] / (right[True, True] + right[True, False]), right[True, True] / (right[True, True] + right[False, True])
    assert recall >= 0.95 and precision >= 0.97, right
