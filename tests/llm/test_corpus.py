import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import mixing, packing, quality, residue, sentences, subjects

RNG = random.Random(2)


def at(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


# sentences ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Dr. Smith of St. Kilda came at 5 p.m. on 2 April. He left.", 2),
        ("They sold wheat, salt, etc. in full. They sold salt, etc. In 1846 they stopped.", 3),
        ("No. 54 was kept; No. 2 was not. pH values of 6.5 were found (cf. fig. 3).", 2),
        ("“Where is the key?” asked Kim. “It rained. We stayed.” Then we left.", 3),
        ("Kim wrote: “It rained. We stayed.” The firm Mat & Co. Ltd. grew. (It had been small by then.) Mr. J. K. Roe left...", 4),
        ("One line\nstill one sentence. Two\r\n\r\nA heading\n\n-- Kim, 13:17", 4),
        ("In full.No. 5 came.“Who?” asked Bo.(It fell.) Prices rose from $1.2 to $2.2.", 5),
        ("Er nannte z. B. Salz usw. als Ware. Am 3. Mai kam Dr. J. Roe. War das schon im 19. Jahrhundert so? „Wo liegt es?“, fragte Kim.", 4),
        ("Seit 1717. Man zählte 69.158 Einwohner! Die Akte Nr. 10 bzw. 59 liegt in St. Ab.", 3),
        ("Le Dr J.-B. Roy hésita... puis partit. « Où est la porte ? » demanda Kim. On cite p. ex. le blé, etc. M. Roy sourit.", 4),
        ("¿Dónde está? ¡Qué sorpresa! El Sr. Roe vio 42.34 kg... y no más. «¿Quién viene?», preguntó Kim.", 4),
        ("«Где ворота?» — спросил Ким. На ул. Новой, д. 5, продавали зерно и т. д. по средам. Т. е. стр. 53 утрачена. Площадь ок. 2,5 кв. км. Всё.", 5),
        ("Πού είναι η πύλη; «Ποιος έρχεται;» ρώτησε ο Κιμ. Το έτος 5 π.Χ. δεν υπήρχε. Ο κ. Ρο ήρθε.", 4),
        ('द्वार कहाँ है? किम ने कहा, "वर्षा हुई। हम रुके।" डॉ. रो आए। 5 कि.मी. है।', 4),
        ("أين البوابة؟ قال كيم: «هطل المطر. بقينا هنا.» وصل د. رو عام 1900.", 3),
        ("门在哪里？“谁来了？”他问道。他说：“下雨了。我们留下。”面积为2.5平方公里。他等着……然后走了。", 5),
        ("門はどこか？「誰が来た？」と彼は尋ねた。彼は「雨が降った。残った。」と言った。彼は待った……そして去った。", 4),
        ("ห้องสมุดเล็ก ประตูอยู่ที่ไหน เขาบอกว่า“ฝนตก เราอยู่ต่อ” ในปี1826 พ่อค้า", 5),
        ("", 0), (" \n\n ", 0), ("no mark at all", 1), ("1. First thing. 2. Second thing.", 2), ("((((", 1), ("...", 1),
    ],
)
def test_sentences(text, n):
    got = at(text)
    assert len(got) == n, got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\"“”(«»)。と1;'’", max_size=80))
def test_spans_cover_the_text(text):
    spans = sentences.sentence_spans(text)
    inside = [False] * len(text)
    for i, (a, b) in enumerate(spans):
        assert a < b and (i == 0 or spans[i - 1][1] <= a) and not text[a].isspace() and not text[b - 1].isspace()
        inside[a:b] = [True] * (b - a)
    assert all(inside[i] or c.isspace() for i, c in enumerate(text))


@pytest.mark.parametrize("unit", ["(", "“", "1.", "a.b.", "”", "“(", '"', "x ", "...", "「"])
def test_long_repeats_are_linear(unit):
    import time

    began = time.monotonic()
    text = unit * (200_000 // len(unit))
    sentences.sentence_spans(text)
    quality.text_statistics(text)
    residue.is_residue(text[:20_000])
    assert time.monotonic() - began < 20


def test_nesting_of_any_depth():
    deep = "“" + "(" * 500 + "One came. Two left." + ")" * 500 + "” Then we left."
    assert len(at(deep)) == 1 or at(deep)[-1].endswith("left.")
    assert sentences._pairs("“" + "[" * 300 + "x”", 0, 303) == {0: 302}


def test_list_levels():
    text = "1. First thing. 2. Second thing:\n\na) one part. b) other part.\n\nI. Inner part. II. More.\n\n3. Third thing.\n\nPlain text. More of it."
    got = [(text[a:b], n) for a, b, n in sentences.leveled_spans(text)]
    assert got[0] == ("1. First thing.", 1) and got[1][1] == 1 and got[-1][1] == 0 and got[-2] == ("Plain text.", 0)
    assert dict(got)["3. Third thing."] == 1 and dict(got)["I. Inner part."] == 3 and dict(got)["II. More."] == 3


def test_sentence_frame(spark):
    rows = [(1, "One came. Two left.", "x"), (1, "One came. Two left.", "x"), (2, None, None), (3, "", "x"), (None, "A.", "x"), (4, "Long one. " * 50_000, "x")]
    got = sentences.sentences(spark.createDataFrame(rows, "doc_id long, text string, id string"), "doc_id", "text")
    n = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert n == {1: 4, 4: 50_000}
    assert sentences.sentences(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


# packing --------------------------------------------------------------------------


def test_differencing_is_balanced():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 200)
    w = packing.difference(sizes, 10)
    sums = np.bincount(w, weights=sizes, minlength=10)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_groups_fit(sizes):
    s = np.array(sizes)
    w = packing.pack_group(s, 60)
    assert np.bincount(w, weights=s).max() <= 60 and len(w) == len(s)


def test_pack_frame(spark):
    rng = random.Random(7)
    texts = {i: "é語x"[rng.randrange(3)] * rng.randint(1, 120) for i in range(1, 301)}
    texts[301] = "語" * 400
    rows = [(i, t, 5) for i, t in texts.items()] + [(1, texts[1], 5), (400, None, 5), (401, "", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container int")
    packed = packing.pack_texts(df, "doc_id", "text", 256, group_items=64)
    got = packed.collect()
    assert {r.id for r in got} == set(texts)
    size: dict = {}
    parts: dict = {}
    for r in got:
        size[r.container] = size.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.id, []).append(r)
    assert max(size.values()) <= 256
    for i, t in texts.items():
        assert sum(r.n_tokens for r in parts[i]) == len(t.encode()) + 1
        assert (len(parts[i]) > 1) == (len(t.encode()) + 1 > 256) == (parts[i][0].n_pieces > 1)
    for r in parts[301]:  # pieces begin at characters
        assert texts[301].encode()[r.start_byte :].decode()
    report = packing.fill_report(packed, 256).first()
    assert report.containers == len(size) and report.unused < 0.12
    assert packing.pack_texts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 256).count() == 0


# mixing -----------------------------------------------------------------------------


def test_mixture(spark):
    rows = [(i, "x" * 9, "Big One") for i in range(600)] + [(1000 + i, "y" * 9, " small-src ") for i in range(20)] + [(2000, None, "big_one"), (2001, "z" * 99, None), (2002, "z" * 99, "other"), (0, "x" * 9, "Big One")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big_one", 0.8, 2), ("small_src", 0.15, 3), ("absent", 0.05, 4)], "source string, weight double, max_repeat int")
    m = mixing.mix_sources(df, targets)
    assert m.budget == 6200
    shares = {r.source: r for r in m.shares().collect()}
    assert {k: r.reachable for k, r in shares.items()} == {"big_one": True, "small_src": False, "absent": False}
    docs = m.documents().collect()
    assert sum(r.n_tokens for r in docs) <= 6200 < sum(r.n_tokens for r in docs) + 20
    assert sum(r.source == "small_src" for r in docs) == 60 and shares["small_src"].tokens == 600
    assert [r.finish for r in docs] == sorted(r.finish for r in docs)
    seen = [(r.id, r.copy) for r in docs]
    assert len(seen) == len(set(seen)) and max(c for _, c in seen) <= 2
    fair = mixing.mix_sources(df, spark.createDataFrame([("big_one", 0.9, 2), ("small_src", 0.1, 3)], "source string, weight double, max_repeat int"), budget=2000)
    got = {r.source: r.actual_share for r in fair.shares().collect()}
    assert abs(got["big_one"] - 0.9) < 0.01 and abs(got["small_src"] - 0.1) < 0.01
    none = mixing.mix_sources(spark.createDataFrame([], df.schema), targets)
    assert none.documents().count() == 0 and {r.reachable for r in none.shares().collect()} == {True}
    assert mixing.mix_sources(df, spark.createDataFrame([], targets.schema)).documents().count() == 0


# residue -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "unit",
    [
        "It was founded in {{year}} by {{founder}}.", "See <%= region %> for more.", "The ${type} has ${count} members.", "%(name)s is a %(type)s.", "[NAME] is a [TYPE] in [DISTRICT].", "It was [insert year here].", "In {3} it was renamed {5}.",
        "Lorem ipsum dolor sit amet urna.", "blah blah blah blah blah", "Heading 3 goes here", "Born: TBD", "Date: ____, Area: XX", "owner (to be filled in); area [ ].", "Error 404: the page you asked for could not be found.",
        "Please turn on JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um den Inhalt zu sehen.", "Access denied.", "Script error: The module \"Foo\" does not exist.", "TODO: write about Kim.", "Your summary here.", "Loading … If nothing happens, check that scripting is permitted.",
    ],
)
def test_residue(unit):
    assert residue.is_residue(unit)


@pytest.mark.parametrize(
    "unit",
    [
        "The phrase “page not found” appears in the title of a play by Kim.", "Designers once filled an empty column with lorem ipsum, a habit that Kim called lazy.", "In shell scripts the form ${HOME} stands for a path.",
        "Editors may leave a placeholder such as [YEAR] in a draft, but the staff replace it.", "The witness said “access denied” when Kim asked for the key [sic].", "Old browsers asked readers to enable JavaScript before the map could be drawn.",
        "When a page is missing, the server answers with status 404 and a short message.", "Null pointers crashed the program.", "An internal error of 18 percent was corrected.", "Founded: – km", "",
    ],
)
def test_no_residue(unit):
    assert not residue.is_residue(unit)


def test_residue_documents(spark):
    seed = "Error 404: the page you asked for could not be found on any of the old servers of this quiet place."
    near = "Error 404! The page we asked for could not be found on any of the old servers of this quiet place."
    prose = "A quiet river runs through the old town. Its bridges were built by hand in the last century."
    rows = [(1, seed, 1), (2, prose, 1), (3, f"{prose}\n\n{seed}", 1), (4, None, 1), (5, "", 1), (None, seed, 1), (1, seed, 1), (6, "{{x}}", 1), (7, "*** ???", 1), (8, prose * 3000, 1), (9, near.replace("we", "you", 1), 1)]
    df = spark.createDataFrame(rows, "Id long, Doc string, key int")
    got = {r.id: r for r in residue.residue_documents(df, "Id", "Doc").collect()}
    assert set(got) == {1, 3, 6, 9}
    assert residue.residue_documents(spark.createDataFrame([], "Id long, Doc string"), "Id", "Doc").count() == 0


FRAMES = [
    ("Click to edit this quiet old paragraph and then tell us what is known about the river of your town", 2),
    ("Replace this paragraph with what you have found about the river and the bridge of this quiet old town", 2),
    ("The database error has come up again on this quiet old server and nobody will mend it before tomorrow morning", 2),
]


def test_planted_copies_without_a_pattern(spark):
    """Labels reach planted copies no pattern matches, and no other sentence."""
    rng = random.Random(31)
    made_up = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    docs, planted, ordinary = {}, set(), set()
    for trusted, breaks in FRAMES:
        docs[len(docs)] = trusted
        assert residue.is_residue(trusted)
        for i in range(40):
            words = trusted.split()
            words[breaks] = made_up()
            for j in range(i % 4):
                words[-1 - j] = made_up()
            copy = " ".join(words)
            assert not residue.is_residue(copy)
            a, b = trusted.lower().split(), copy.lower().split()
            shared = sum(min(a.count(w), b.count(w)) for w in set(a))
            (planted if shared >= 0.8 * (len(a) + len(b) - shared) else ordinary).add(len(docs))
            docs[len(docs)] = f"A river runs by the old town. {copy}. It was built by hand." if i % 8 < 4 else copy
    for i in range(60):
        ordinary.add(len(docs))
        docs[len(docs)] = " ".join(rng.choice("river town bridge hand old built quiet market north king stone water".split()) for _ in range(12))
    for line in ("Access Denied.", "Access Road.", "Denied access."):  # of short lines only the same words are near, and names count
        (planted if line == "Denied access." else ordinary).add(len(docs))
        docs[len(docs)] = line
    ordinary.discard(len(docs) - 3)
    got = {r.id: r.n_trusted for r in residue.residue_documents(spark.createDataFrame(list(docs.items()), "Id long, Doc string"), "Id", "Doc").collect()}
    found = {i for i, trusted in got.items() if trusted == 0}
    assert len(planted) >= 60 and len(ordinary) > 100 and planted <= found, planted - found
    # copies beyond the likeness may be near to other copies, ordinary sentences to none
    assert not {i for i in ordinary & found if docs[i].split()[0] not in ("Click", "Replace", "The", "A")}


HELD_OUT = [
    "500 Internal Server Error", "HTTP 429 Too Many Requests", "{name} was born in {city}.", "Insert description here", "HTTP/1.1 404 Not Found", "Error 403: Forbidden", "Please enable cookies and reload the page.", "Sample text", "Your text here",
    "Type your headline here", "${first_name} ${last_name}", "Sorry, something went wrong.", "An unexpected error occurred.", "Connection timed out", "Fatal error: Uncaught exception in module", "This page is under construction", "Loading...", "Undefined index: title", "Failed to load resource",
]
ORDINARY = [
    "The court refused the request and the conflict was gone by 1450.", "In 404 the city was taken by the army.", "The museum holds 500 not found elsewhere.", "The set {a, b} has two members.", "Loading of the ship took two days.", "The service was unavailable during the war.",
    "The gateway was built in 502.", "She sorted the cookies on the table.", "The site is under construction by the council.", "He typed the letter here.", "A sample of the text was found.", "The script of the play was required reading.",
]


def test_held_out_lines():
    assert all(map(residue.is_residue, HELD_OUT)) and not any(map(residue.is_residue, ORDINARY))


@pytest.mark.parametrize("length", [150, 399, 401, 599, 601, 723, 3000, 30_000])
def test_length_does_not_matter(spark, length):
    """Residue is cut out, and seen, in texts of any length; so are quotations."""
    error = "Error 404: the page you asked for could not be found."
    prose = "The old town lies on the river and was built by the king of the land. "
    text = (prose * (length // len(prose) + 1))[:length].rstrip() + ". " + error + " " + prose
    trusted = residue.Trusted()
    assert error not in trusted.without([text])[0] and prose.strip() in trusted.without([text])[0]
    df = spark.createDataFrame([(1, text), (2, prose * (length // 50))], "Id long, Doc string")
    assert {r.id: r.residue for r in quality.statistics(df, "Id", "Doc").collect()} == {1: True, 2: False}
    assert not residue.is_residue(f"He said “{prose * (length // 70)}{error}” and left")


def test_long_reference_lines():
    line = "“A history of the town” in the old journal, " + "with much that is said of it, " * 200 + "vol. 12"
    assert quality.text_statistics(line)["list_share"] == 1 and quality.text_statistics("“" * 50_000 + " x")["n_lines"] == 1


def test_labels_move_on_and_names_do_not_hinder(spark):
    words = "the page you asked for could not be read from any of our quiet old discs this very cold morning".split()
    texts = [f"Error 404: {' '.join(words)}."]
    words[2] = "one"
    texts.append(f"Sorry, {' '.join(words)}.")
    for i in range(0, 20, 2):
        words[i : i + 2] = [f"{'abcdefghij'[i // 2]}lt", f"{'abcdefghij'[i // 2]}rk"]
        texts.append(f"Sorry, {' '.join(words)}.")
    names = "Kim Bo Al Roe Ute Max Tom Eva"
    texts += [f"Error 404: the page you asked for at {names} {names} is gone.", f"Sorry 404: the page we asked for at {names} {names} is gone and so on.", f"Error: the page one asked for at {names} {names} is gone."]
    assert [i for i, t in enumerate(texts) if residue.is_residue(t)] == [0, 12]
    got = {r.id for r in residue.residue_documents(spark.createDataFrame(list(enumerate(texts)), "Id long, Doc string"), "Id", "Doc").collect()}
    assert got == {*range(13), 14}


FILLER = st.lists(st.sampled_from(sorted(residue.LATIN | residue.REPEATED | {"Kim", "7", "x“y”"})), min_size=4, max_size=9).map(" ".join) | st.lists(st.sampled_from(["abc", "Foo", "bar"]), min_size=4, max_size=6).map(" ".join)


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.one_of(FILLER, *(st.from_regex(p) for p in (residue._FIELD, residue._UNFILLED, residue._NOTICE, residue._FILLER))))
def test_residue_is_suspected(unit):
    if residue.is_residue(unit):
        assert residue.suspects(unit + "\n", np.array([0]), residue._automaton(), residue._letters()).tolist() == [0]


def test_every_residue_unit_is_tested(spark):
    texts = ["Born: TBA", "abc abc abc abc", "This text does not work without JS.", "Sed enim ad minim veniam nostrud quis.", "Magna aliqua nulla morbi. Lectus sapien quis nonum.", "403 Forbidden", "502 Bad Gateway", "A quiet river runs through the old town."]
    docs = spark.createDataFrame(list(enumerate(texts)), "Id long, Doc string")
    assert {r.id: r.n_units for r in residue.residue_documents(docs, "Id", "Doc").collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}


def test_near_wording_is_found(spark):
    rest = "could not be found on any of the old servers of this quiet place."
    field = "The {{building}} stands near the river in the western part of this old district and is kept by its council"
    texts = {
        1: f"Error 404: the page you asked for {rest}", 2: f"Sorry, the page we asked for {rest}", 3: f"Sorry, the page we asked for {rest[:-1]} today", 4: "Sorry, the map of this old place could not be drawn by any of our servers.",
        5: f"{field}.", 6: f"{field.replace('{{building}}', 'building')}.", 7: f"{field.replace('{{building}}', '((building))').replace('western', '{eastern4}')}.",
    }
    assert [i for i, t in texts.items() if residue.is_residue(t)] == [1, 5]
    got = {r.id: (r.n_units, r.n_trusted) for r in residue.residue_documents(spark.createDataFrame(list(texts.items()), "Id long, Doc string"), "Id", "Doc").collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (1, 0), 5: (1, 1), 7: (1, 0)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=4, max_size=30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 15)), max_size=4), st.lists(st.integers(0, 15), unique=True, max_size=6))
def test_like_units_share_a_rare_word(a, changes, common):
    b = list(a)
    for place, word in changes:
        b[place % len(b)] = word
    common = np.sort(np.array(common, np.uint32))
    owner, token = residue.rarest_words([np.array(x, np.uint32).tobytes() for x in (a, b)], common, np.arange(common.size), 0.8)
    shared = sum(min(a.count(w), b.count(w)) for w in set(a))
    if shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9:
        assert set(token[owner == 0]) & set(token[owner == 1])


# quality ---------------------------------------------------------------------------------

PROSE = "The old town lies on the river and was built by the king. It has a market that is held in the spring. Many of the people who live there work in the harbour."
LIST = "\n".join(f"{i}. Bridge of Ab{i}" for i in range(1, 25))
TABLE = "Year | Bridge | Total\n" + "\n".join(f"{1900 + i} | old bridge | {i}.5" for i in range(20))
CELLS = "\n".join(x for i in range(12) for x in ("Name", f"{i}", "n/a", "–"))
JUNK = ["xkq vbnt rrtp wqzx mnbv kjhg tyrw plkj zxcv bnmq wrtp sdfg hjkl qwrt " * 3, "#$%^&*{}|~<>@ " * 20, "key drum pitch " * 60, "transplanted ferry amateur benign scored rehearsed legacy album performed wartime sang pension glacier tunnel verdict sauce " * 1, "ThÃ© Ã¼ld tÃ¼wn lÃ©Ã©s Ã¼n thÃ© rÃ¼vÃ©r Ã¼nd wÃ¼s bÃ¼Ã¼lt by thÃ© kÃ©ng. " * 3]


def test_types(spark):
    rows = [(i, PROSE.replace("old", f"old{i}")) for i in range(60)] + [(100 + i, LIST) for i in range(10)] + [(200 + i, TABLE) for i in range(10)] + [(300 + i, t) for i, t in enumerate(JUNK)] + [(400, CELLS)]
    rows += [(500, None), (501, " \n "), (None, PROSE), (502, "x"), (503, PROSE * 400), (0, PROSE.replace("old", "old0"))]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "Id long, Doc string, pattern string")
    types, rates = quality.text_types(df, "Id", "Doc")
    kind = {r.id: r.kind for r in types.collect()}
    assert all(kind[i] == "prose" for i in [*range(60), 503]) and all(kind[100 + i] == "list" for i in range(10)) and all(kind[200 + i] == "table" for i in range(10))
    assert all(kind[300 + i] == "junk" for i in range(len(JUNK))), {i: kind[300 + i] for i in range(len(JUNK))}
    assert kind[400] == "table" and 500 not in kind and 501 not in kind and 502 in kind
    learnt = {r.rule: r for r in rates.collect()}
    assert learnt["prose_lines"].prose > 0.9 and learnt["prose_lines"].junk < 0.2
    empty, none = quality.text_types(spark.createDataFrame([], "Id long, Doc string"), "Id", "Doc")
    assert empty.count() == 0 and none.count() == 0


def test_statistics_of_a_text():
    s = quality.text_statistics("The cat sat.\n- 12 %")
    assert s["n_words"] == 3 and s["n_lines"] == 2 and 0 < s["digit_ratio"] < 0.3
    assert quality.text_statistics(" ") == dict.fromkeys(quality.STATS, 0.0)


# subjects --------------------------------------------------------------------------------

VOCAB = {"law": "court judge verdict trial appeal statute clause lawyer".split(), "food": "bread butter soup oven spice grain cheese flour".split(), "music": "opera choir melody violin drum chord concert tenor".split()}


_R = random.Random(77)
NAMES = ["".join(_R.choice("bdfglmnprst") + _R.choice("aeiou") for _ in range(3)).capitalize() for _ in range(400)]
FILL = ["".join(_R.choice("bdfglmnprst") + _R.choice("aeiou") for _ in range(4)) for _ in range(3000)]


def article(rng, subs, n=12):
    out = []
    for i in range(n):
        w = VOCAB[subs[i % len(subs)]]
        out.append(f"The {rng.choice(w)} and the {rng.choice(w)} were near the {rng.choice(w)} of {rng.choice(NAMES)} and {rng.choice(NAMES)} {rng.choice(FILL)} {rng.choice(FILL)} {rng.choice(FILL)} {rng.choice(FILL)}.")
        if i % 4 == 0:
            out.append("None of this was written down until later years.")
    return " ".join(out)


def test_subjects_held_out(spark):
    rng = random.Random(11)
    names = sorted(VOCAB)
    truth = {i: rng.sample(names, rng.choice([1, 1, 2])) for i in range(1, 261)}
    docs = [(i, f"T{i}", article(rng, s), 0) for i, s in truth.items()]
    labels = [(i, x, 1) for i in range(1, 161) for x in truth[i] if rng.random() > 0.15] + [(3, "unknown", 1), (9999, "law", 1), (1, truth[1][0], 1)]
    extra = [(1000, None, None, 0), (1001, "t", "", 0), (None, "t", article(rng, ["law"]), 0), (1002, "t", "court judge verdict " * 60, 0), (1003, None, article(rng, ["food"], 600), 0), (1004, "t", "Access denied.", 0), docs[0]]
    df = spark.createDataFrame(docs + extra, "Id long, Title string, Doc string, subject int")
    lab = spark.createDataFrame(labels, "id long, subject string, Id2 int")
    got: dict = {}
    for r in subjects.assign(df, lab, names, "Id", "Doc", "Title").collect():
        got.setdefault(r.id, set()).add(r.subject)
    held = range(161, 261)
    right = sum(got.get(i, set()) == set(truth[i]) for i in held)
    assert right >= 95, right
    assert got[1003] == {"food"} and not {1000, 1001, 1002, 1004, None} & set(got)
    assert subjects.assign(df.limit(0), lab, names, "Id", "Doc", "Title").count() == 0
    assert subjects.assign(df, lab.limit(0), names, "Id", "Doc", "Title").count() == 0
