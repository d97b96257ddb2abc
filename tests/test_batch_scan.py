"""All plain rules are looked up together over a batch of texts; the rest of the work on matches is one step as well."""

from cloakframe import catalog as C
from cloakframe.operators import detect as D
from cloakframe.operators import scan
from cloakframe.operators import tokenize as T

TEXT = "bank 128683320066 and Account #412868332, born 12/25/1966 é mail a.b@example.org; EMP-0066 token=\"3295c76acbf4caaed33c\" (212) 555-1234 \U0001f600PROJ-0066"


def test_the_catalogue_is_searched_in_one_step_without_a_regex_per_rule(spark):
    rows = spark.createDataFrame([(1, TEXT)], "id int, text string")
    made = D.with_rule_spans(rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "PROJ-" not in plan and "regexp_extract_all" not in plan and plan.count("ArrowEvalPython") == 2
    assert {s.label for s in made.first().spans} >= {"BANK_ACCOUNT", "EMAIL_ADDRESS", "DATE_OF_BIRTH", "EMPLOYEE_ID", "PHONE_NUMBER", "PROJECT_ID"}


def test_few_places_are_tried():
    """A pattern runs where its first characters stand, not at every word."""
    tried = []

    class Counted:
        def __init__(self, pattern):
            self.match = lambda text, at, m=scan.re.compile(pattern).match: tried.append(at) or m(text, at)

    patterns = tuple(scan._pattern(r) for r in C.CATALOGUE)
    table = scan.np.zeros((scan.DEPTH, scan.OTHER + 1, 2), scan.np.uint64)
    for k, r in enumerate(C.CATALOGUE):
        for depth, allowed in enumerate(scan.first_characters(r)):
            table[depth, allowed, k // 64] |= scan.np.uint64(1 << k % 64)
    kept, scan._compiled = scan._compiled, lambda p: [Counted(x).match for x in p]
    try:
        found = scan._find([TEXT * 20], patterns, scan.np.zeros(2, scan.np.uint64), table)
    finally:
        scan._compiled = kept
    assert len(found) >= 20 * 10 and len(tried) <= 5 * len(found)


def test_rules_of_both_kinds_keep_their_numbers_and_null_texts_have_none(spark):
    rules = [C.Rule("A", "twin", r"\b(x)y\1\b", 0.5), C.Rule("B", "digits", r"\b\d{3}\b", 0.5), C.Rule("C", "inner", r"q\d", 0.5)]
    rows = spark.createDataFrame([(1, "é xyx 123 aq7 é123 xyx"), (2, None), (3, "")], "id int, text string")
    found = {r["id"]: [tuple(m) for m in r["matches"]] for r in D.with_matches(rows, rules=rules).collect()}
    assert sorted(found[1], key=lambda m: (m[3], m[0])) == [(2, 5, "xyx", 0), (19, 22, "xyx", 0), (6, 9, "123", 1), (11, 13, "q7", 2)]
    assert found[2] == found[3] == []
    assert scan.scanner(rules)[1] == [0]


def test_context_reaches_five_words_back_over_any_blanks(spark):
    rule = C.Rule("NO", "no", r"\b\d{4}\b", 0.3, context=("ledger",))
    texts = ["ledger a b c d 1234", "ledger a b c d e 1234", "Ledger\ta\nb\rc d1 1234", "ledger" + " " * 5 + "1234", "ledger" + " " * 6 + "1234", "x" * 500 + "ledger " + "y" * 500 + " 1234"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: round(r["spans"][0]["score"], 6) for r in D.with_rule_spans(rows, rules=[rule]).collect()}
    assert got == {0: 0.65, 1: 0.3, 2: 0.65, 3: 0.65, 4: 0.3, 5: 0.65}
    plain = D.with_rule_spans(rows, rules=[rule], context_words=0, trim="off").filter("id = 0").first()
    assert plain["spans"][0]["score"] == 0.3


def test_shared_labels_detect_once(spark):
    """Rows are read several times for one token per value, but detected once."""
    rows = spark.createDataFrame([(1, 7, "bank 412345678"), (2, 7, "passport 412345678"), (3, 8, "bank 412345678")], "id int, scope int, text string")
    for options in ({}, {"in_memory": 0}):
        made = T.with_shared_labels(T.with_entities(D.with_rule_spans(rows)), ["scope"], "id", **options)
        assert "ArrowEvalPython" not in made._jdf.queryExecution().optimizedPlan().toString()
        labels = {r["id"]: r["entities"][0]["label"] for r in made.collect()}
        assert labels[1] == labels[2] == labels[3] == "BANK"
