import random

from helpers import rows

from adlake.llm import decontaminate as d

SCHEMA = "doc_id long, text string, key string, hash string, item_id string"
ITEM = ("A train leaves Paris at 9 and travels 240 km to Lyon in 3 hours. If Anna pays 45 dollars for the train to Lyon, "
        "how many km does the train travel in 1 hours?")


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in rows(d.contaminated(docs, bench))}


def test_copies_and_new_parameters_are_found(spark):
    changed = ITEM.replace("Paris", "Madrid").replace("Lyon", "Toledo").replace("240", "310").replace("Anna", "Ben")
    mixed_up = ITEM.replace("train to Lyon", "train to Nice").replace("to Lyon in", "to Lille in")   # one value, two fillings
    merged = ITEM.replace("Lyon", "Anna")                                                             # two values, one filling
    texts = [(1, f"Some words before this. {ITEM} And some after it."), (2, f"x y {changed}"), (3, mixed_up * 1), (4, "nothing of the kind here at all"),
             (5, " ".join(ITEM.split()[:14])), (6, ITEM.replace(" ", "\n\t ")), (7, None), (8, ""), (9, "short"), (None, ITEM), (1, "other text of the same id"),
             (10, ITEM), (10, ITEM), (11, ITEM.replace("train", "**train**").replace(".", " .").replace(" .", ".")), (12, merged)]
    got = found(spark, texts, [(1, ITEM), (1, None), (2, ITEM), (3, "too few words"), (None, "")])
    assert {k for k in got} == {(1, 1), (2, 1), (6, 1), (None, 1), (10, 1), (11, 1)}
    assert {k for k, r in got.items() if r["reparameterised"]} == {(2, 1)}


def test_equals_brute_force_without_slots(spark):
    rng = random.Random(2)
    vocabulary = [f"w{c}" for c in "abcdefghij"]
    frame = [rng.choice(vocabulary) for _ in range(12)]
    items = [(i, " ".join(frame * (i % 2) + [rng.choice(vocabulary) for _ in range(rng.randrange(2, 14))])) for i in range(25)]
    texts = []
    for n in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            piece = rng.choice(items)[1].split()
            w += piece[: rng.randrange(len(piece) + 1)] if rng.random() < .5 else piece
        texts.append((n, " ".join(w)))

    def windows(t):
        w = t.split()
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    want = set()
    for n, t in texts:
        here = set(windows(t))
        for i, item in items:
            whole = windows(item)
            if whole and sum(w in here for w in whole) >= 0.8 * len(whole):
                want.add((n, min(j for j, other in items if other == item)))
    assert set(found(spark, texts, items)) == want and want


def test_clean_keeps_the_rest_and_its_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, "a", "b", "c"), (2, "fine", "a", "b", "c"), (2, "fine", "a", "b", "c"), (None, None, "a", "b", "c")], SCHEMA)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in rows(kept)) == ["2", "2", "None"]
    assert d.clean(docs, bench.limit(0)).count() == 4 and d.clean(docs.limit(0), bench).count() == 0


def test_same_result_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert set(found(spark, [(1, ITEM), (2, "a b c d e f g")], [(1, ITEM)])) == {(1, 1)}


def test_main_path_has_no_python(spark, sf_dir):
    from adlake.llm import queries
    plan = queries.QUERIES["op5_benchmark_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_case_and_the_words_before_do_not_matter(spark):
    short = "Marie often reads old books about Roman roads near Lyon"
    texts = [(1, ITEM.upper()), (2, f"The text is: {ITEM.title()} and more"), (3, ITEM.lower()), (4, f"and then {short} today"), (5, short.upper())]
    assert set(found(spark, texts, [(1, ITEM), (2, short)])) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}


def test_a_conflicting_slot_drops_its_own_windows_only(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60)]
    item = " ".join("5" if i in (10, 50) else "3" if i == 30 else w for i, w in enumerate(plain))
    one_value, one_origin = item.replace("5", "7", 1), item.replace("3", "5")
    got = found(spark, [(1, one_value), (2, one_origin), (3, item)], [(1, item)])
    assert {i: r["n_matched"] for (i, _), r in got.items()} == {1: 51, 2: 51, 3: 56}


def test_names_at_the_start_number_words_and_units(spark):
    pairs = [("Tom has 5 apples. Tom gives 2 to Mary.", "Sam has 7 apples. Sam gives 3 to Ann."),
             ("then the teacher asked why O'Brien walked home so early", "then the teacher asked why O’Hara walked home so early"),
             ("a worker needs three days for a wall and two for a door", "a worker needs 4 days for a wall and six for a door"),
             ("she reads for 1 hour and drives a 4 mile lap in the rain", "she reads for 2 Days and drives a 3 KM lap in the rain"),
             ("how long does \"Rob\" wait if \"Rob\" leaves one day late", "how long does \"Jim\" wait if \"Jim\" leaves twenty-one weeks late")]
    items = [(i, item) for i, (item, _) in enumerate(pairs)]
    got = found(spark, [(i, f"xx yy {text} zz" if i else text) for i, (_, text) in enumerate(pairs)], items)
    assert {k: r["reparameterised"] for k, r in got.items()} == {(i, i): True for i in range(len(pairs))}
    capitals = [(1, "Who Wrote The Old Book About Rome"), (2, "MANY OTHER CAPITALS ARE HERE IN ROWS")]
    assert found(spark, capitals[1:], capitals[:1]) == {}


def test_names_and_numbers_of_more_or_fewer_words(spark):
    short = "the teacher from Paris asked how many books the children read in one week of school"
    items = [(1, ITEM), (2, short), (3, "San Jose has two hundred old houses and San Jose sells 30 of them every year")]
    texts = [(1, f"x y {ITEM.replace('Lyon', 'San Jose')} and so on"), (2, f"and {short.replace('Paris', 'New York')} then"),
             (3, "Lyon has 200 old houses and Lyon sells twenty five of them every year"),
             (4, ITEM.replace("Paris", "Rio de Janeiro").replace("Anna", "Anna Maria Smith").replace("Lyon", "New York")),
             (5, ITEM.replace("to Lyon in", "to San Jose in").replace("train to Lyon", "train to New York")),   # one name, two fillings
             (6, ITEM), (7, "New York, San Jose, Los Angeles and Rio Grande are here in New York 20 30 40 times")]
    got = found(spark, texts, items)
    assert {k: r["reparameterised"] for k, r in got.items()} == {(1, 1): True, (2, 2): True, (3, 3): True, (4, 1): True, (6, 1): False}


def test_slots_of_runs_are_the_raw_words(spark):
    df = spark.createDataFrame([(1, "then  Anna Maria,\tBob\nCole walk 20 30 km to O'Brien Hall. New Lane")], "id int, text string")
    got = {r["place"]: r["slots"] for r in rows(d.folded_windows(df, ["id"], "place"))}
    assert got[0] == [None, "Anna Maria,", "Bob Cole", None, "20 30"]
    assert got[3] == [None, "20 30", "km", None, "O'Brien Hall."]


MARKET = "If Anna buys 20 apples at the old market, she doesn't pay more than two hundred euros — says ΟΔΥΣΣΕΥΣ.five about José's naïve plan."


def test_texts_without_a_run_of_plain_words_are_left_out(spark):
    """What is left out has no wanted window, whatever stands between and inside the words; plain texts go."""
    odd = [MARKET, MARKET.upper(), MARKET.replace(" ", "\t \n"), MARKET.replace(" ", " - "), MARKET.replace("20", "1,000.5").replace("Anna", "Mary Lou"),
           MARKET.replace("'", "").replace(",", " ,"), "x" + MARKET, MARKET.replace("a", "a\ue003"), MARKET.replace(" ", "\ue005"),
           MARKET.replace("two hundred", "200"), MARKET.replace("—", "\u00a0"), "(" + MARKET.replace(" ", ") (") + ")", "a\ue000b " + MARKET]
    rng = random.Random(7)
    words = MARKET.split()
    odd += [" ".join(words[k:k + 9]) + rng.choice([" ", ". ", " 7 "]) + " ".join(rng.sample(words, 12)) for k in range(14)]
    plain = [" ".join(rng.sample(words, len(words))) for _ in range(40)] + ["", " ", "--", "the market", None]
    docs = spark.createDataFrame(list(enumerate(odd + plain)), "doc_id long, text string").filter("text IS NOT NULL")
    items = d.item_windows(spark.createDataFrame([(1, MARKET), (2, MARKET.replace("apples", "pears"))], "item_id long, text string"))
    wanted = d.seeds(items)
    assert {r["row"] for r in rows(wanted.select("run.row"))} == {3}
    kept = {r["doc_id"] for r in rows(d.likely(docs, wanted))}
    hit = {r["doc_id"] for r in rows(d.hashes(docs, ["doc_id"]).join(wanted, "hash", "left_semi"))}
    assert hit <= kept and {0, 1, 2, 5, 9} <= hit and len(kept) < len(odd) + 20


def test_items_without_plain_words_leave_all_texts_in(spark):
    docs = spark.createDataFrame([(1, "3 4 5 6 7 8"), (2, "nothing of that kind here at all")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "3 4 5 6 7 8")], "item_id long, text string")
    wanted = d.seeds(d.item_windows(item))
    assert d.likely(docs, wanted).count() == 2
    one = spark.createDataFrame([(1, "3 pears 4 5 6 7 8 9")], "item_id long, text string")
    few = d.seeds(d.item_windows(one))
    kept = {r["doc_id"] for r in rows(d.likely(docs.union(spark.createDataFrame([(3, "1 Pears! 2 3 4 5 6 7")], docs.schema)), few))}
    assert 3 in kept


def test_many_runs_leave_all_texts_in(spark, monkeypatch):
    docs = spark.createDataFrame([(1, MARKET), (2, "nothing")], "doc_id long, text string")
    wanted = d.seeds(d.item_windows(spark.createDataFrame([(1, MARKET)], "item_id long, text string")))
    assert d.likely(docs, wanted).count() == 1
    monkeypatch.setattr(d, "RUNS", 2)
    assert d.likely(docs, wanted).count() == 2
