"""Variant spellings of the names of persons and organisations.

Every name is rewritten to a reading: accents, case, titles, possessives and articles
go, "Last, First" and "Form, Core" are turned, legal forms are spelled out, initials and nicknames
are noted. Readings send out forms: the ways in which somebody may have typed them (with a
nickname's formal names, with initials, with one letter left out, which makes any single typo
meet). Forms are exploded and equi-joined, variants on one side, readings that they may stand for
on the other. A rewriting is scored by its rarity, one over the number of readings that it may stand
for; a variant joins the entity that holds nearly all of the rarity of its best rewritings, so a
rewriting that leads to several different entities alike links nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.names_json import named
from corpusmill.session import materialize

# Formal given names and their nicknames.
NICKNAMES = {
    "alexander": "alex al sandy xander sasha", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate cat",
    "charles": "charlie chuck", "christina": "tina chrissy", "christine": "chris tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie debby", "dennis": "den denny", "donald": "don donny", "dorothy": "dot dotty dottie dolly", "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth betty eliza lizzie bess libby",
    "eugene": "gene", "frances": "fran frannie", "francis": "frank", "frederick": "fred freddie freddy", "gerald": "gerry jerry", "gregory": "greg", "hannah": "hanna",
    "harold": "harry hal", "henry": "hank harry", "jacob": "jake", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny jenn", "jessica": "jess jessie",
    "john": "jack johnny jon", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie kat kitty", "kathleen": "kathy", "kenneth": "ken kenny",
    "kimberly": "kim", "lawrence": "larry lars laurie", "leonard": "len lenny", "louis": "lou", "margaret": "maggie meg peggy marge greta", "martha": "marty patty", "mary": "molly polly",
    "matthew": "matt", "michael": "mike mick mickey", "nancy": "nan", "nathaniel": "nat nate", "nicholas": "nick nicky", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "quentin": "quin", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby bert", "ronald": "ron ronnie", "russell": "russ", "samuel": "sam sammy",
    "sandra": "sandy", "sarah": "sally", "stephen": "steve", "steven": "steve", "stuart": "stu", "susan": "sue susie", "susanna": "sue susie susan", "theodore": "ted theo teddy", "theresa": "terry tess",
    "thomas": "tom tommy", "timothy": "tim", "valerie": "val", "victor": "vic", "victoria": "vicky vic tori", "vincent": "vince", "virginia": "ginny", "walter": "walt", "william": "bill will billy liam", "zachary": "zach",
}
# Titles and suffixes of persons.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame rev hon".split())
SUFFIXES = frozenset("jr sr phd md esq ii iii iv".split())

# Words of the kind or legal form of an organisation, and their abbreviations.
FORMS = {
    "academy": "acad", "agency": "agcy", "archive": "arch", "associates": "assocs", "association": "assoc assn asso", "authority": "auth", "bank": "bk", "brothers": "bros bro", "bureau": "bur", "center": "ctr", "centre": "", "college": "coll",
    "commission": "comm", "committee": "cttee", "company": "co coy", "consortium": "", "cooperative": "coop", "corporation": "corp", "council": "cncl", "department": "dept dpt", "development": "dev", "education": "educ",
    "engineering": "eng engg engr", "enterprises": "ent", "federation": "fed", "foundation": "fdn fndn found", "geology": "geol", "gmbh": "", "group": "grp", "holdings": "hldgs", "hospital": "hosp", "house": "hse", "incorporated": "inc", "industries": "inds", "institute": "inst",
    "instruments": "instr", "international": "intl int", "laboratory": "lab", "laboratories": "labs", "library": "lib", "limited": "ltd", "llc": "", "llp": "", "makers": "", "management": "mgmt", "manufacturing": "mfg", "ministry": "min", "museum": "mus", "national": "natl",
    "office": "off", "organization": "org", "partners": "ptnrs", "plc": "", "press": "", "proprietary": "pty", "publishing": "publ pub", "research": "res rsch", "school": "sch", "science": "sci", "services": "svcs", "society": "soc", "software": "", "sons": "", "systems": "sys", "technology": "tech", "trust": "", "union": "", "university": "univ uni", "works": "wks",
}
# Legal forms of several words, by their short word; and legal forms of one word with another's initials.
PHRASES = {"llc": "limited liability company", "llp": "limited liability partnership", "plc": "public limited company", "gmbh": "gesellschaft mit beschrankter haftung"}
LEGAL = {"aktiengesellschaft": "AG", "kommanditgesellschaft": "KG"}
SMALL = frozenset("of and the for".split())

#: A word is a given name if it stands first beside so many different surnames, and over twice as many as it stands last behind, unless
#: a spelling one typo away has so many times its partners. Beyond the first few names, only counts of one corpus are compared.
GIVEN_PARTNERS, MISSPELT = 3, 5
#: Part of the rarity of a variant's best rewritings that the entity it joins must hold.
SURE = 0.9
PERSON, ORG = "p", "o"


@dataclass
class Tables:
    """The word lists of the rewritings; others may be given to every operator here."""

    nicknames: Mapping[str, str] = field(default_factory=lambda: NICKNAMES)
    forms: Mapping[str, str] = field(default_factory=lambda: FORMS)
    phrases: Mapping[str, str] = field(default_factory=lambda: PHRASES)
    legal: Mapping[str, str] = field(default_factory=lambda: LEGAL)
    titles: frozenset = TITLES
    suffixes: frozenset = SUFFIXES

    def __post_init__(self) -> None:
        self.formal: dict[str, set[str]] = {}
        for full, nicks in self.nicknames.items():
            for nick in nicks.split():
                self.formal.setdefault(nick, set()).add(full)
        self.words = {short: word for word, shorts in self.forms.items() for short in (word, *shorts.split())} | {w: w for w in self.legal}


DEFAULT = Tables()


def fold(name: str) -> str:
    """Lower case, without accents."""
    plain = unicodedata.normalize("NFKD", name)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def one_edit(a: str, b: str) -> bool:
    """Equal, or one letter apart: inserted, left out, changed, or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


def shortened(word: str) -> list[str]:
    """The word, and the word with each letter left out (words of five letters or more)."""
    return [word, *sorted({word[:i] + word[i + 1 :] for i in range(len(word))})] if len(word) > 4 else [word]


def spelled(token: str, tables: Tables = DEFAULT) -> str | None:
    """The word of an organisation's form that the token stands for, one typo allowed in four letters or more."""
    if token in tables.words:
        return tables.words[token]
    if len(token) < 4:
        return None
    return next((w for s, w in tables.words.items() if len(s) > 3 and one_edit(token, s)), None)


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", text)


def _plain(name: str) -> str:
    text = fold(re.sub("[‘’ʼ]", "'", name)).replace("&", " and ").strip()
    return re.sub(r"'s?$", "", text).strip()


def organisation(name: str, tables: Tables = DEFAULT) -> tuple[str, str] | None:
    """(core, form): the proper words, and the words of kind in full or, in capitals, their initials. None if it has no words of kind."""
    text = _plain(name)
    text = re.sub(r"^the\s+", "", text)
    for short, phrase in tables.phrases.items():
        text = text.replace(phrase, short)
    kind = lambda t: spelled(t, tables)
    if text.count(",") == 1:
        head, tail = (x.strip() for x in text.split(","))
        if head and tail and all(kind(t) or t in SMALL for t in _tokens(head)):
            text = f"{tail} {head}"  # Form, Core
    tokens = _tokens(text)
    if len(tokens) > 2 and tokens[1] == "of" and kind(tokens[0]) and not any(kind(t) for t in tokens[2:]):
        tokens = [*tokens[2:], tokens[0]]  # Form of Core
    words = [kind(t) for t in tokens]
    k = next((i for i, w in enumerate(words) if w and i), None)
    if k is not None and all(w or t in SMALL for w, t in zip(words[k:], tokens[k:])):
        return " ".join(tokens[:k]), " ".join(w or t for w, t in zip(words[k:], tokens[k:]))
    if len(tokens) > 1 and re.search(r"\s[A-Z]{2,4}(?:'s)?$", name) and re.fullmatch("[a-z]{2,4}", tokens[-1]):
        return " ".join(tokens[:-1]), tokens[-1].upper()
    return None


def initials(form: str, tables: Tables = DEFAULT) -> str:
    return form if form.isupper() else "".join(tables.legal.get(w, w[0]) for w in form.split() if w not in SMALL).upper()


def person(name: str, tables: Tables = DEFAULT) -> tuple[list[str], bool]:
    """(words, whether a comma fixed their order): given names first; initials are single letters, titles and suffixes are gone."""
    text = _plain(name)
    parts = [_tokens(re.sub(r"(?<=\b\w)\.", " ", x)) for x in text.split(",")]
    parts = [[t for t in p if t not in tables.titles and not (i and t in tables.suffixes)] for p in parts for i in [len(parts) > 1]]
    parts = [p for p in parts if p]
    if len(parts) == 2:
        return parts[1] + parts[0], True
    return [t for p in parts for t in p], False


def mentions(df: DataFrame, column: str) -> DataFrame:
    """name, n, persons, orgs, others: how often each name is typed, and as what. Counted within tasks before the shuffle."""
    columns = ["name", "n", "persons", "orgs", "others"]

    def rows(found: Counter) -> pa.RecordBatch:
        names = [k[0] for k in found]
        kinds = [k[1] for k in found]
        counts = list(found.values())
        values = [counts, *([c if k == want else 0 for k, c in zip(kinds, counts)] for want in (PERSON, ORG, "x"))]
        return pa.record_batch([pa.array(names, pa.string()), *(pa.array(v, pa.int64()) for v in values)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for name, kind in named(text):
                    k = (kind or "UNKNOWN").upper()
                    found[name, PERSON if k == "PERSON" else ORG if k in ("ORG", "ORGANIZATION") else "u" if k in ("UNKNOWN", "") else "x"] += 1
            if len(found) > 100_000:
                yield rows(found)
                found = Counter()
        yield rows(found)

    counted = df.select(column).mapInArrow(run, "name string, n long, persons long, orgs long, others long")
    return counted.groupBy("name").agg(*(F.sum(c).alias(c) for c in columns[1:]))


_READ = "name string, n long, persons long, orgs long, others long, core string, form string, first string, middle string, last string, turned boolean, og string, om string, os string"


def _read(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, *counts in zip(*(c.to_pylist() for c in b.columns)):
                org = organisation(name, tables) or (None, None)
                words, turned = person(name, tables)
                ok = len(words) >= 2 and not any(c.isdigit() for c in name) and len(words[-1]) > 1
                whole = (words[0], "".join(w[0] for w in words[1:-1]), words[-1]) if ok else (None, None, None)
                other = (words[1], "".join(w[0] for w in words[2:]), words[0]) if ok and not turned and len(words[0]) > 1 and len(words[1]) > 1 else (None, None, None)
                out.append((name, *counts, *org, *whole, turned, *other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], names=_NAMES)

    return run


_NAMES = [x.split()[0] for x in _READ.split(", ")]
_ARROW = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _READ.split(", ")]


def given_names(read: DataFrame) -> DataFrame:
    """word: the given names of the corpus, by ``GIVEN_PARTNERS`` and ``MISSPELT``."""
    people = read.where((F.col("last").isNotNull()) & (F.col("persons") > 0) & ~F.col("turned") & (F.length("first") > 1)).select("first", "last").distinct()
    first = people.groupBy(F.col("first").alias("word")).agg(F.count("*").alias("partners"))
    last = people.groupBy(F.col("last").alias("word")).agg(F.count("*").alias("behind"))
    stands = _joined(first, last, "word", "left").where((F.col("partners") >= GIVEN_PARTNERS) & (F.col("partners") > 2 * F.coalesce("behind", F.lit(0)))).select("word", "partners")
    stands = materialize(stands, "p5-given")
    # spellings one typo apart share a form with one letter left out; a close look at those that meet decides
    left = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    forms = stands.where(F.length("word") > 4).select("word", "partners", F.explode(F.array_distinct(F.concat(F.array("word"), left))).alias("form"))
    near = _joined(forms, forms.select(F.col("word").alias("other"), F.col("partners").alias("many"), "form"), "form").where((F.col("word") != F.col("other")) & (F.col("many") >= MISSPELT * F.col("partners")))
    wrong = near.where(F.levenshtein("word", "other") <= 2).select("word").distinct()
    return _joined(stands, wrong, "word", "left_anti").select("word")


def readings(df: DataFrame, column: str, tables: Tables = DEFAULT) -> DataFrame:
    """name, n, kind, g (given name or words of kind), i (their initials), m (middle initials), s (surname or core), rank,
    given (whether g is known as a given name), og, om, os (given name, middle initials and surname in the other token order, null if a comma or an initial fixes it).

    rank: 0 initials only, 1 a nickname, 2 a full given name that few share, 3 one that many share; organisations have 0 (initials only) or 3.
    Names of other kinds are left out. The order of two words without a comma is turned if only the second is a given name in this corpus; either way the other order is kept as a second reading.
    """
    read = materialize(mentions(df, column).mapInArrow(_read(tables), _READ), "p5-read")
    given = given_names(read)
    nick = F.create_map(*(F.lit(x) for k in sorted(tables.formal) for x in (k, True))) if tables.formal else F.create_map().cast("map<string,boolean>")
    known = lambda c: F.coalesce(nick[F.col(c)], F.lit(False))
    read = _joined(_joined(read, given.select(F.col("word").alias("first"), F.lit(True).alias("k1")), "first", "left"), given.select(F.col("word").alias("last"), F.lit(True).alias("k2")), "last", "left")
    read = read.withColumns({"k1": F.coalesce("k1", F.lit(False)) | known("first"), "k2": F.coalesce("k2", F.lit(False)) | known("last")})
    typed = F.greatest("persons", "orgs", "others") > 0
    short = F.length("first") == 1
    is_org = F.col("core").isNotNull() & F.when(typed, (F.col("orgs") >= F.col("persons")) & (F.col("orgs") >= F.col("others"))).otherwise(F.lit(True))
    is_person = F.col("last").isNotNull() & F.when(typed, (F.col("persons") >= F.col("orgs")) & (F.col("persons") >= F.col("others"))).otherwise(F.col("k1") | F.col("k2") | short)
    turn = ~F.col("turned") & F.col("k2") & ~F.col("k1") & ~short & (F.col("middle") == "")
    g, s = F.when(turn, F.col("last")).otherwise(F.col("first")), F.when(turn, F.col("first")).otherwise(F.col("last"))
    orgs = read.where(is_org).select("name", "n", F.lit(ORG).alias("kind"), F.col("form").alias("g"), F.lit("").alias("m"), F.col("core").alias("s"), F.when(F.upper("form") == F.col("form"), 0).otherwise(3).alias("rank"), F.lit(False).alias("given"), *(F.lit(None).cast("string").alias(c) for c in ("og", "om", "os")))
    persons = read.where(is_person & ~is_org).select("name", "n", F.lit(PERSON).alias("kind"), g.alias("g"), "middle", s.alias("s"), (turn | F.col("k1")).alias("k"), F.when(turn, F.col("first")).otherwise(F.col("og")).alias("og"), "om", F.when(turn, F.col("last")).otherwise(F.col("os")).alias("os"))
    nicknames = nick[F.col("g")]
    rank = F.when(F.length("g") == 1, 0).when(F.coalesce(nicknames, F.lit(False)), 1).when(F.col("k"), 3).otherwise(2)
    persons = persons.select("name", "n", "kind", "g", F.col("middle").alias("m"), "s", rank.alias("rank"), (F.col("k") | F.col("g").isin(sorted(tables.nicknames))).alias("given"), "og", "om", "os")
    return orgs.unionByName(persons)


def _forms(tables: Tables):
    """(node, side, rule, form, og, om, os) of nodes (node, kind, g, s, rank, others): side 0 may be a variant, side 1 what it stands for.

    Rules: t one typo, n nickname, i initials, o the other token order (og, om and os are its words)."""
    formal_of = tables.formal
    no = (None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, kind, g, s, rank, others in zip(*(c.to_pylist() for c in b.columns)):
                for o in others or ():
                    for f in sorted({o["og"]} | formal_of.get(o["og"], set())):
                        out += [(node, 0, "o", f"{kind}s|{f}|{d}", o["og"], o["om"], o["os"]) for d in shortened(o["os"])]
                    out += [(node, 0, "o", f"{kind}g|{d}|{o['os']}", o["og"], o["om"], o["os"]) for d in shortened(o["og"])]
                if rank and kind == PERSON:
                    out += [(node, 1, "o", f"{kind}s|{g}|{d}", *no) for d in shortened(s)]
                    out += [(node, 1, "o", f"{kind}g|{d}|{s}", *no) for d in shortened(g)]
                first = [initials(g, tables)] if kind == ORG else sorted({g[0]} | {f[0] for f in formal_of.get(g, ())})
                formal = sorted(formal_of.get(g, ())) if kind == PERSON else []
                for d in shortened(s):
                    if rank:
                        out += [(node, side, "t", f"{kind}s|{g}|{d}", *no) for side in (0, 1)]
                        out += [(node, 0, "n", f"{kind}n|{f}|{d}", *no) for f in formal]
                        if not formal:
                            out.append((node, 1, "n", f"{kind}n|{g}|{d}", *no))
                        out += [(node, 1, "i", f"{kind}i|{f}|{d}", *no) for f in first]
                    else:
                        out += [(node, side, "i", f"{kind}i|{f}|{d}", *no) for f in first for side in (0, 1)]
                if rank and kind == PERSON:
                    out += [(node, side, "t", f"{kind}g|{d}|{s}", *no) for d in shortened(g) for side in (0, 1)]
            cols = list(zip(*out)) or [[]] * 7
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.string()) for c in cols[3:])], ["node", "side", "rule", "form", "og", "om", "os"])

    return run


_EDGE = "x string, y string, rule string, xg string, xs string, xrank int, xn long, xm string, yg string, ys string, yrank int, yn long, ym string, xgiven boolean, ygiven boolean, xfirst string, rarity double"


def _check(tables: Tables):
    """Edges whose spellings really are at most one typo apart; ``cost`` counts the typos."""
    formal = tables.formal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, cost = [], []
            for i, (rule, xg, xs, xrank, yg, ys, yrank) in enumerate(zip(*(b.column(c).to_pylist() for c in ("rule", "xg", "xs", "xrank", "yg", "ys", "yrank")))):
                if not one_edit(xs, ys):
                    continue
                if rule == "o" and xg != yg and yg not in formal.get(xg, ()) and (xs != ys or not one_edit(xg, yg)):
                    continue
                if rule == "t" and xg != yg and (xs != ys or not one_edit(xg, yg) or xrank in (1, 3) and yrank in (1, 3)):
                    continue
                keep.append(i)
                cost.append(int(xs != ys) + int(rule in "to" and xg != yg))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(keep, pa.int64())).columns, pa.array(cost, pa.int32())], names=[*b.schema.names, "cost"])

    return run


def _joined(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is shuffled whatever Spark takes the sides' sizes for: both grow with the names, so neither is broadcast."""
    return a.join(b.hint("merge"), on, how)


def _settled(root: DataFrame, name: str) -> DataFrame:
    """x, root and score with every chain of roots followed to its end; each round halves the chains and is written out."""
    root = materialize(root, name)
    while True:
        onward = _joined(root, root.select(F.col("x").alias("root"), F.col("root").alias("next"), F.col("score").alias("then")), "root")
        root = materialize(onward.select("x", F.col("next").alias("root"), F.least("score", "then").alias("score"), (F.col("next") != F.col("root")).alias("moved")), name)
        if root.where("moved").isEmpty():
            return root.drop("moved")
        root = root.drop("moved")


def clusters(df: DataFrame, column: str, tables: Tables = DEFAULT) -> DataFrame:
    """name, entity (the reading that stands for all its variants) and score of every name of a person or organisation.

    The score is the rarity of the most common rewriting on the way to the entity: one over the readings that it may stand for; 1 for a name that is its entity's own reading.
    A null, broken or other JSON text has no names; blank names and elements that aren't objects are skipped; an empty table has no rows. Repeated
    rows only add to the counts, which decide what a typo stands for. Nothing that grows with the names is broadcast: joins are shuffled, and Spark splits a form that many names share.
    """
    named_ = materialize(readings(df, column, tables).withColumn("node", F.concat_ws("|", "kind", F.when(F.col("rank") == 0, F.concat_ws(".", "g", "m")).otherwise(F.col("g")), "s")), "p5-readings")
    nodes = named_.groupBy("node", "kind", "g", "s", "rank").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("m"), F.lit("")))), " ").alias("m"), F.max("given").alias("given"), F.collect_set(F.when(F.col("og").isNotNull(), F.struct("og", "om", "os"))).alias("others"))
    nodes = materialize(nodes, "p5-nodes")
    forms = nodes.select("node", "kind", "g", "s", "rank", "others").mapInArrow(_forms(tables), "node string, side int, rule string, form string, og string, om string, os string")
    x, y = forms.where("side = 0").select(F.col("node").alias("x"), "rule", "form", "og", "om", "os").distinct(), forms.where("side = 1").select(F.col("node").alias("y"), "rule", "form").distinct()
    leads = y.groupBy("rule", "form").agg(F.count("*").alias("leads"))  # by the keys of the join, so nothing more is shuffled
    met = _joined(_joined(x, y, ["rule", "form"]), leads, ["rule", "form"]).where("x <> y").groupBy("x", "y", "rule", "og", "om", "os").agg((1 / F.min("leads")).alias("rarity"))
    side = lambda p: nodes.select(F.col("node").alias(p), *(F.col(c).alias(p + c) for c in ("g", "s", "rank", "n", "m", "given")))
    edges = _joined(_joined(met, side("x"), "x"), side("y"), "y").withColumns({"xfirst": F.col("xg"), "xg": F.coalesce("og", "xg"), "xm": F.coalesce("om", "xm"), "xs": F.coalesce("os", "xs")}).select(*(e.split()[0] for e in _EDGE.split(", "))).mapInArrow(_check(tables), _EDGE + ", cost int")
    edges = materialize(edges, "p5-edges")

    # a typo stands for the more frequent spelling next to it; chains of typos end at the most frequent
    better = (F.col("yrank") > F.col("xrank")) | ((F.col("yrank") == F.col("xrank")) & ((F.col("yn") > F.col("xn")) | ((F.col("yn") == F.col("xn")) & (F.col("y") < F.col("x")))))
    typo = edges.where((F.col("rule") == "t") & better).groupBy("x").agg(F.max_by("y", F.struct("yn", "y")).alias("up"), F.max_by("rarity", F.struct("yn", "y")).alias("rarity"))
    root = _joined(nodes.select(F.col("node").alias("x")), typo, "x", "left").select("x", F.coalesce("up", "x").alias("root"), F.coalesce("rarity", F.lit(1.0)).alias("score"))
    root = _settled(root, "p5-roots")

    def lift(rule: str, allowed, root: DataFrame, edges: DataFrame = edges) -> DataFrame:
        """Variants by one rule join the entity that holds ``SURE`` of the rarity of their best rewritings: those of the fewest typos, with agreeing middle initials if any agree."""
        to = _joined(edges.where((F.col("rule") == rule) & allowed), root.select(F.col("x").alias("y"), F.col("root").alias("to")), "y")
        agree = (F.col("xm") != "") & (F.col("ym") != "") & F.exists(F.split("xm", " "), lambda m: F.array_contains(F.split("ym", " "), m))
        differ = (F.col("xm") != "") & (F.col("ym") != "") & ~agree
        to = to.where(~differ).groupBy("x", "to").agg(F.min("cost").alias("cost"), F.max(agree.cast("int")).alias("agree"), F.max("yrank").alias("yrank"), F.max("yn").alias("yn"), F.max("rarity").alias("rarity"))
        best = to.groupBy("x").agg(F.max(F.struct(F.col("agree"), -F.col("cost"), (F.col("yrank") > 1).cast("int"))).alias("best"))
        to = _joined(to, best, "x").where((F.col("agree") == F.col("best.agree")) & (F.col("cost") == -F.col("best.col2")) & ((F.col("yrank") > 1).cast("int") == F.col("best.col3")))
        only = to.groupBy("x").agg(F.sum("rarity").alias("all"), F.max("rarity").alias("rarity"), F.max_by("to", F.struct("rarity", "to")).alias("to")).where(F.col("rarity") >= SURE * F.col("all"))
        moved = only.select(F.col("x").alias("root"), "to", "rarity")
        # whatever stood for the variant moves with it
        return materialize(_joined(root, moved, "root", "left").select("x", F.coalesce("to", "root").alias("root"), F.least("score", F.coalesce("rarity", F.lit(1.0))).alias("score")), f"p5-{rule}")

    # of two orders the one stands whose first word is more likely a given name; if both are given names, they may be two persons
    partners = materialize(nodes.where(F.col("kind") == PERSON).groupBy("g").agg(F.countDistinct("s").alias("partners")), "p5-partners")
    of = lambda c: partners.select(F.col("g").alias(c), F.col("partners").alias(c + "_partners"))
    turned = edges.where((F.col("rule") == "o") & ~(F.col("xgiven") & F.col("ygiven")))
    turned = _joined(_joined(turned, of("xfirst"), "xfirst"), of("yg"), "yg")
    turned = turned.where(F.struct("ygiven", "yg_partners", "yn", "y") > F.struct("xgiven", "xfirst_partners", "xn", "x"))
    root = lift("o", F.lit(True), root, turned)
    root = lift("n", F.lit(True), root)
    root = lift("i", F.col("yrank") > 0, root)
    alone = _joined(root.where("x = root").select(F.col("root").alias("x")), nodes.where("rank = 0").select(F.col("node").alias("x")), "x")
    left = _joined(edges, alone, "x", "left_semi").where((F.col("rule") == "i") & (F.col("yrank") == 0) & better & ((F.col("xm") == F.col("ym")) | (F.col("xm") == "")))
    up = left.groupBy("x").agg(F.max_by("y", F.struct("yn", "y")).alias("up"), F.max_by("rarity", F.struct("yn", "y")).alias("rarity"))
    root = _joined(root, up.withColumnRenamed("x", "root"), "root", "left").select("x", F.coalesce("up", "root").alias("root"), F.least("score", F.coalesce("rarity", F.lit(1.0))).alias("score"))
    root = _settled(root, "p5-last")
    return _joined(named_.select("name", F.col("node").alias("x")), root, "x").select("name", F.col("root").alias("entity"), "score")


def pairs(df: DataFrame, column: str, tables: Tables = DEFAULT) -> DataFrame:
    """name_a < name_b (by code point): spellings that mean the same person or organisation. ``clusters`` has them as one row per name."""
    found = materialize(clusters(df, column, tables), "p5-clusters")
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return _joined(a, b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
