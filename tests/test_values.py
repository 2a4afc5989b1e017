from pyspark.sql import functions as F

from docreg.functions import values as V
from docreg.functions.distance import char_distance, word_distance


def one(df, **columns):
    return df.select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_trim_covers_control_characters_and_blank_is_null(rows):
    df = rows("v string", (" \t x \n",), ("\x0b\0 ",), (None,))
    assert [r.v for r in one(df, v=V.normalise_value(F.col("v")))] == ["x", None, None]


def test_two_meanings_of_corrected(rows):
    df = rows("o string, v string", (None, "Ana"), ("Ana", " Ana "), ("ana", "Ana"), ("Ana", None))
    o, v = F.col("o"), F.col("v")
    assert [r.c for r in one(df, c=V.was_corrected(o, v))] == [True, False, True, True]
    assert [r.c for r in one(df, c=V.differs_from_ocr(o, v))] == [False, False, True, True]
    assert [r.c for r in one(df, c=V.differs_from_ocr(o, v, "ci"))] == [False, False, False, True]


def test_search_is_literal_unless_asked(rows):
    df = rows("v string", ("50% paid",), ("505 paid",), ("Élan",))
    c = F.col("v")
    assert [r.h for r in one(df, h=V.contains_text(c, "50%"))] == [True, False, False]
    assert [r.h for r in one(df, h=V.contains_text(c, "50% p", literal=False))] == [True, True, False]
    assert [r.h for r in one(df, h=V.contains_text(c, "elan", accents=False))] == [False, False, True]


def test_labels_none_is_a_label(rows):
    df = rows("v string", ("None",), ("",), (" unreadable ",), ("Ana",), (None,))
    assert [r.u for r in one(df, u=V.is_usable_label(F.col("v")))] == [True, False, False, True, False]


def test_optional_integers(rows):
    df = rows("v string", (None,), ("",), ("   ",), ("1",), ("0",), ("1.5",), ("x",))
    got = one(df, p=V.positive_int(F.col("v")), n=V.non_negative_int(F.col("v")))
    assert [r.p for r in got] == [None, None, None, 1, None, None, None]
    assert [r.n for r in got] == [None, None, None, 1, 0, None, None]


def test_order_without_group_is_dropped(rows):
    df = rows("g string, o string", ("2", None), (None, "1"), ("1", "0"))
    g, o = V.person_metadata(F.col("g"), F.col("o"))
    assert [tuple(r) for r in one(df, g=g, o=o)] == [(2, None), (None, None), (1, 0)]


def test_confidence_and_percentage(rows):
    df = rows("c double", (None,), (float("nan"),), (float("inf"),), (120.0,), (-3.0,), (55.5,))
    assert [r.c for r in one(df, c=V.normalise_confidence(F.col("c")))] == [0.0, 0.0, 0.0, 100.0, 0.0, 55.5]
    df = rows("c double", (0.8766,), (-1.0,), (2.0,))
    assert [r.c for r in one(df, c=V.percentage(F.col("c")))] == [87.7, 0.0, 100.0]


def test_percentage_rounds_after_scaling(rows):
    """1 - 0.3705 is 62.949999999999996 %, which SQL rounds to 63.0."""
    df = rows("r double", (0.3705,), (0.3765,), (0.2665,))
    assert [r.p for r in one(df, p=V.percentage(1 - F.col("r")))] == [63.0, 62.4, 73.4]


def test_redaction_keeps_other_keys_and_adds_none(rows):
    df = rows("m map<string,string>", ({"password": "x", "name": "Ana"},), ({"temporary_password": None},), (None,))
    assert [r.m for r in one(df, m=V.redact(F.col("m")))] == [
        {"password": "[redacted]", "name": "Ana"}, {"temporary_password": "[redacted]"}, None]


def test_dirty_diff_has_moved_columns_only(rows):
    df = rows("o struct<a:string,b:int,updated_at:string>, n struct<a:string,b:int,updated_at:string>",
              (("x", 1, "t1"), ("x", None, "t2")))
    before, after = V.dirty_diff("o", "n", ["a", "b", "updated_at"])
    assert tuple(one(df, b=before, a=after)[0]) == ({"b": "1"}, {"b": None})


def test_filter_map_drops_empty_entries(rows):
    df = rows("m map<string,string>", ({"doc_type": "birth", "from": "2026-01-01", "to": None},))
    assert one(df, m=V.compact_filters(F.col("m")))[0].m == {"doc_type": "birth", "from": "2026-01-01"}


def test_names_slugs_and_paths(rows):
    df = rows("v string", ("  ../My  set! ",), ("...",), (None,), ("Été_1",))
    assert [r.v for r in one(df, v=V.sanitise_name(F.col("v")))] == ["My set", None, None, "Été_1"]
    df = rows("v string", ("Certificate of  Birth!",), ("Été",), ("##",))
    assert [r.v for r in one(df, v=V.slug(F.col("v"), "layout"))] == ["certificate-of-birth", "ete", "layout"]


def test_small_formats(rows):
    df = rows("n string", ("maria clara santos",), ("  ana ",))
    assert [r.i for r in one(df, i=V.initials(F.col("n")))] == ["MC", "A"]
    df = rows("a string", ("change_request.opened",))
    assert one(df, t=V.action_title(F.col("a")))[0].t == "Change Request Opened"
    df = rows("u string", ("data:image/png;base64,QUJD",), ("QUJD",))
    assert [bytes(r.b) for r in one(df, b=V.decode_data_url(F.col("u")))] == [b"ABC", b"ABC"]
    df = rows("s string, o string, w double, h double", ("a4", "landscape", None, None), ("custom", "portrait", 100.5, 200.0))
    args = [F.col(c) for c in "sowh"]
    w, h = V.paper_dimensions(*args)
    got = one(df, w=w, h=h, t=V.paper_label(args[0], args[2], args[3]))
    assert [tuple(r) for r in got] == [(297.0, 210.0, "210 × 297 mm"), (100.5, 200.0, "100.5 × 200 mm")]


def test_distances(rows):
    df = rows("r string, h string", ("kitten", "sitting"), ("the cat sat on mat", "the cat sit mat"), ("", ""), ("", "ab"),
              ("éàü", "eau"), ("a  b\tc", " a b c "), (None, "a"))
    got = one(df, c=char_distance(F.col("r"), F.col("h")), w=word_distance(F.col("r"), F.col("h")))
    assert [r.c for r in got][:5] == [3, 4, 0, 2, 3]
    assert [r.w for r in got] == [1, 2, 0, 1, 1, 0, None]


def test_word_distance_against_brute_force(spark, rows):
    import random

    random.seed(7)
    alphabet = ["a", "b", "cc", "d", "é", "ff"]
    pairs = [tuple(" ".join(random.choice(alphabet) for _ in range(random.randint(0, 9))) for _ in range(2)) for _ in range(60)]

    def brute(a, b, i=0, j=0, memo=None):
        memo = {} if memo is None else memo
        if (i, j) not in memo:
            if i == len(a) or j == len(b):
                memo[i, j] = len(a) - i + len(b) - j
            else:
                memo[i, j] = min(brute(a, b, i + 1, j, memo) + 1, brute(a, b, i, j + 1, memo) + 1,
                                 brute(a, b, i + 1, j + 1, memo) + (a[i] != b[j]))
        return memo[i, j]

    df = rows("r string, h string", *pairs).coalesce(1)
    got = [r.w for r in one(df, w=word_distance(F.col("r"), F.col("h")))]
    assert got == [brute(r.split(), h.split()) for r, h in pairs]


def test_word_distance_past_the_surrogates(spark, rows):
    many = [f"w{i}" for i in range(55_400)]
    df = rows("r string, h string", (" ".join(many), " ".join([many[0], many[55_050], "other", many[-1]])))
    assert one(df, w=word_distance(F.col("r"), F.col("h")))[0].w == 55_400 - 3


def test_fixed_column_names_need_an_automatic_person_of_eleven(rows):
    f = rows("id int, kind string, mode string, size int, position int, name string",
             (1, "person", "auto", 11, 2, "x"), (2, "person", "manual", 11, 2, "x"), (3, "details", "auto", 11, 2, "x"),
             (4, "person", "auto", 10, 2, ""), (5, None, "auto", 11, 0, None))
    label = V.column_label(*(F.col(c) for c in ("kind", "mode", "size", "position", "name")))
    assert [r[0] for r in f.orderBy("id").select(label).collect()] == ["Child's name", "x", "x", "Field 3", "Field 1"]
