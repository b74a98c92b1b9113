"""Cosine decides; letters only between entries within the margin, and as an exact check where asked for."""

from tidemark.llm import canonical

REF = [(1, "Zellaune"), (2, "Zelluacz"), (3, "Torvmere"), (4, "Orlovmere"), (5, "Mount Kormenille"), (6, "Saint Emmuua")]
WORDS, NOISE, SIGNS = {"mt": "mount", "st": "saint"}, (r"^in ", r" desk$"), {"3": "e", "0": "o"}


def _map(spark, values, **options):
    ref = spark.createDataFrame(REF, "i int, n string")
    return {r["v"]: r["i"] for r in canonical.map_values(spark.createDataFrame([(v,) for v in values], "v string"), "v", ref, "i", "n", **options).collect()}


def test_a_swap_goes_to_the_nearest_by_letters(spark):
    assert _map(spark, ["Zelluane", "Trovmere", "Zelluacz"]) == {"Zelluane": 1, "Trovmere": 3, "Zelluacz": 2}


def test_tables_are_what_the_caller_gives(spark):
    values = ["Mt Kormenille", "in Z3llaune desk", "T0rvm3r3", "St Emmuua"]
    assert _map(spark, values, words=WORDS, noise=NOISE, signs=SIGNS, most_slips=0) == {"Mt Kormenille": 5, "in Z3llaune desk": 1, "T0rvm3r3": 3, "St Emmuua": 6}
    assert set(_map(spark, values, most_slips=0).values()) == {-1}


def test_the_exact_check_is_an_option(spark):
    assert _map(spark, ["Mount Kobrone"]) == {"Mount Kobrone": 5} and _map(spark, ["Mount Kobrone"], most_slips=3) == {"Mount Kobrone": -1}
    assert _map(spark, ["Mount Kobrone"], threshold=0.9) == {"Mount Kobrone": -1}


def test_prefix_filter_loses_nothing(spark):
    values = ["Zellaun", "Zelaune", "Torvmere x", "Orlovmeer", "mere", "Kormenille", "aune", "Emmuua Saint"]
    some = {t: _map(spark, values, threshold=t, margin=0.0) for t in (0.05, 0.4)}
    low = canonical.map_values(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame(REF, "i int, n string"), "i", "n", threshold=0.05, margin=0.0)
    sure = {r["v"]: r["i"] for r in low.collect() if r["score"] >= 0.4}
    assert sure and {v: some[0.4][v] for v in sure} == sure
