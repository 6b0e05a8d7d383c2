"""Typed searches: the forms that the reference pins, and the odd ones."""

import pytest

from tracklens.functions.search_log import normalize_search_log

#: input, exact, window, min, max, wildcard, keywords, empty
GOLDEN = [
    ("3:16", 196000, 1000, None, None, None, None, False),
    ("3:16.423", 196423, 1, None, None, None, None, False),
    ("3:00 to 4:00", None, None, 180000, 240999, None, None, False),
    ("between 3:00 and 4:00", None, None, 180000, 240999, None, None, False),
    (">10:00", None, None, 600000, None, None, None, False),
    ("<3:00", None, None, None, 179999, None, None, False),
    ("love 4:20", 260000, 1000, None, None, None, "love", False),
    ("pink floyd", None, None, None, None, None, "pink floyd", False),
    ("con*", None, None, None, None, "con*", None, False),
    ("*tion", None, None, None, None, "*tion", None, False),
    ("*con*", None, None, None, None, "*con*", None, False),
    ("", None, None, None, None, None, None, True),
    ("  \t ", None, None, None, None, None, None, True),
    (None, None, None, None, None, None, None, True),
    (">10", None, None, None, None, None, ">10", False),
    ("3:16.4", 196400, 100, None, None, None, None, False),
    ("3:16.42", 196420, 10, None, None, None, None, False),
    ("3:75", 255000, 1000, None, None, None, None, False),
    ("1:02:03", 62000, 1000, None, None, None, ":03", False),
    ("123:45 to 4:00", None, None, 1425000, 240999, None, "1", False),
    ("4:00 to 3:00", None, None, 240000, 180999, None, None, False),
    ("duck <3:00", None, None, None, 179999, None, "duck", False),
    ("> 2:00 <3:00", None, None, 120000, 179999, None, None, False),
    ("a* b*", None, None, None, None, "a*", "b*", False),
    ("*", None, None, None, None, None, "*", False),
    ("** a*", None, None, None, None, None, "** a*", False),
    ("3:00 – 4:00", 180000, 1000, None, None, None, "– 4:00", False),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, query string")
    out = normalize_search_log(df).select("i", "exact_ms", "window_ms", "min_ms", "max_ms", "wildcard", "keywords", "is_empty")
    return {r.i: tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(parsed, i):
    assert parsed[i] == GOLDEN[i][1:]
