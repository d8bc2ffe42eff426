import re

from pyspark.sql import functions as F

from lexgrain.functions import english
from lexgrain.functions.english import snowball
from lexgrain.functions.fulltext import STOP_WORDS

# The sample vocabulary that is published with the algorithm, word and stem, in its order.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead
knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife
knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


def test_published_vocabulary():
    pairs = dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
    assert len(pairs) == 80 and {w: snowball(w) for w in pairs} == pairs


def test_rules_named_in_the_description():
    pairs = {
        "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopped": "hop", "hoped": "hope", "hoping": "hope",
        "bee": "bee", "agreed": "agre", "proceed": "proceed", "inning": "inning", "innings": "inning", "by": "by", "say": "say", "cry": "cri", "generate": "generat", "general": "general",
        "generic": "generic", "communication": "communic", "community": "communiti", "arsenic": "arsenic", "arsenal": "arsenal", "skis": "ski", "skies": "sky", "dying": "die", "ugly": "ugli",
        "news": "news", "youth": "youth", "boy": "boy", "boyish": "boyish", "sky": "sky", "rational": "ration", "relational": "relat", "hopefulness": "hope", "formative": "format",
        "apology": "apolog", "apologies": "apolog", "feudalism": "feudal", "bed": "bed", "shed": "shed", "shred": "shred", "bead": "bead", "embed": "emb", "beds": "bed", "ow": "ow",
        "uni's": "uni", "'tis": "tis", "vileli": "vile", "adoption": "adopt", "roll": "roll", "controll": "control", "rate": "rate", "ed": "ed", "naïve": "naïv",
    }
    assert {w: snowball(w) for w in pairs} == pairs


def test_stems_are_no_longer_than_words_and_need_no_ascii():
    for w in ("", "a", "'", "''s", "ü" * 50, "中文", "yyyy", "sses", "ies", "'s", "li", "eed", "ing"):
        assert len(snowball(w)) <= len(w)


def test_typed_tokens(spark):
    text = "State-of-the-art E-mail me@example.org; see www.example.com/a/b?c=1 or example.com. Version 3.11.2, 12 items, C3PO and naïve Über-Wörter x2-y"
    rows = spark.createDataFrame([(text,), (None,), ("... --- /",)], "t string").select(english.typed_tokens(F.col("t")).alias("ts")).collect()
    assert [(r.kind, r.token) for r in rows[0].ts] == [
        ("compound", "state-of-the-art"), ("word", "state"), ("word", "of"), ("word", "the"), ("word", "art"), ("compound", "e-mail"), ("word", "e"), ("word", "mail"),
        ("email", "me@example.org"), ("word", "see"), ("url", "www.example.com/a/b?c=1"), ("host", "www.example.com"), ("path", "/a/b?c=1"), ("word", "or"), ("host", "example.com"),
        ("word", "version"), ("number", "3.11.2"), ("number", "12"), ("word", "items"), ("numword", "c3po"), ("word", "and"), ("word", "naïve"), ("compound", "über-wörter"), ("word", "über"), ("word", "wörter"),
        ("numword", "x2-y"), ("numword", "x2"), ("word", "y"),
    ]
    assert rows[1].ts == rows[2].ts == []


def test_lexemes_keep_positions(spark):
    docs = spark.createDataFrame([(1, "The cats of well-known hosts"), (2, None)], "id long, t string")
    rows = sorted((r.pos, r.kind, r.lexeme) for r in english.lexemes(docs, "id", "t", STOP_WORDS).collect())
    assert rows == [(2, "word", "cat"), (4, "compound", "well-known"), (5, "word", "well"), (6, "word", "known"), (7, "word", "host")]


def test_stem_table(spark):
    words = spark.createDataFrame([("running",), ("running",), ("runs",), (None,)], "lexeme string")
    assert sorted(map(tuple, english.stem_table(words).collect())) == [("running", "run"), ("runs", "run")]
    assert re.fullmatch("[a-z ]+", " ".join(STOP_WORDS))


def test_lexeme_arrays(spark):
    rows = spark.createDataFrame([(["the", "cats", "of", "cats"],), (None,), ([],), (["running", None],)], "ts array<string>")
    got = [r.x for r in rows.select(english.lexeme_arrays(STOP_WORDS)(F.col("ts")).alias("x")).collect()]
    assert [list(x or []) for x in got] == [[None, "cat", None, "cat"], [], [], ["run", None]]


def test_a_token_of_several_batches_is_stemmed_once(spark, monkeypatch):
    import pyarrow as pa

    asked, whole = [], english.snowball
    monkeypatch.setattr(english, "snowball", lambda w: asked.append(w) or whole(w))
    stems = english.lexeme_arrays(frozenset({"the"})).func
    for _ in range(3):
        assert stems(pa.array([["the", "ponies"], [], ["ponies"]])).to_pylist() == [[None, "poni"], [], ["poni"]]
    assert asked == ["ponies"]
