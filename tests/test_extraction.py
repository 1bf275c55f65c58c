"""Outputs of models: strict parsing, grounding, table cells."""

from lorespark.operators import extraction
from lorespark.plans.candidates import _OUTPUTS


def test_strict_parsing(spark):
    texts = [t for t, _, _ in _OUTPUTS] + ["", None, '{"entities": [], "entities": []}', '{"relations": {}}', '{"entities": [null]}', '{"entities": [{"name": "A", "entity_type": "人物", "aliases": [null]}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, output string")
    got = [(r.category, None if r.parsed is None else len(r.parsed.entities)) for r in extraction.parsed(df).orderBy("i").collect()]
    assert got[: len(_OUTPUTS)] == [(c, n) for _, c, n in _OUTPUTS]
    assert [c for c, _ in got[len(_OUTPUTS) :]] == ["invalid_json"] * 3 + ["schema_validation"] * 3


def test_too_many(spark):
    one = '{"name": "A%d", "entity_type": "人物"}'
    many = lambda n: '{"entities": [' + ",".join(one % i for i in range(n)) + "]}"
    df = spark.createDataFrame([(0, many(100)), (1, many(101))], "i int, output string")
    assert [r.category for r in extraction.parsed(df).orderBy("i").collect()] == ["ok", "schema_validation"]


def test_both_ends_must_be_named_by_the_evidence(spark):
    entities = spark.createDataFrame([("d", "e1", "France", ["République"]), ("d", "e2", "Europe", None), ("d", "e3", "Nice", ["the town"]), ("d", "e4", "Lyon", ["the town"])], "document_id string, entity_id string, name string, aliases array<string>")
    texts = spark.createDataFrame([("d", "ＦＲＡＮＣＥ  lies in Europe. Nice is a town.")], "document_id string, text string")
    cases = [("France", "Europe", "France lies"), ("France", "Europe", "lies in Europe"), ("république", "EUROPE", "France lies in  Europe"), ("France", "Europe", "france lies in europe"), ("the town", "Europe", "lies in Europe"), ("France", "Asia", "France"), ("France", "Europe", "in Asia"), ("France", "France", "France lies"), ("Nice", "Europe", "")]
    relations = spark.createDataFrame([("d", i, s, t, "r" + str(i if i < 2 or i > 4 else 2), e) for i, (s, t, e) in enumerate(cases)], "document_id string, relation_no int, source string, target string, relation_type string, evidence string")
    got = [r.status for r in extraction.grounded_relations(relations, entities, texts).orderBy("relation_no").collect()]
    assert got == ["target", "source", "duplicate", "ground", "endpoint", "endpoint", "evidence", "ground", "evidence"]


def test_cells():
    assert extraction.markdown_rows("| a | b |\n|:--|--:|\n| x \\| y | |\n\n||\nplain\n a | b\\c ") == [["a", "b"], ["x | y", ""], ["a", "b\\c"]]
    assert extraction.markdown_rows(None) == []


def test_html_cells(spark):
    html = "<table><tr><th>a<br/>b</th></tr><tr><td></td></tr><TR x='<'><td><b>1</b>&amp;</td><td> 2\n3</td></TR></table>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(extraction.html_cells("h").alias("c")).collect()
    assert [r.c for r in got] == [[["a b"], ["1&", "2 3"]], []]
