"""Normal texts and gram sets are made once, however often the steps behind them read them."""

from lectern.operators import corpus as C


def test_forms_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(C, "written", lambda df, name, real=C.written: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    body = " ".join(f"word{i} of the text" for i in range(60))
    docs = spark.createDataFrame([(1, body), (2, body + " end"), (3, "short"), (4, "Short"), (5, None), (6, body)], "doc_id long, text string")
    roots = {r.doc_id: r.root for r in C.duplicate_roots(docs).collect()}
    assert roots == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 1}
    assert [n for n, _ in made] == ["normal", "grams", "sets"]
    assert all("lower(" not in plan for n, plan in made if n != "normal")


def test_texts_are_compared_to_their_end(spark):
    """Equal beginnings, however long, don't link texts that go on differently; equal whole texts do."""
    same = " ".join(f"word{i}" for i in range(700))  # over 4000 normal characters
    rest = lambda x: " ".join(f"{x}{i}" for i in range(700))
    docs = [(1, f"{same} {rest('one')}"), (2, f"{same} {rest('two')}"), (3, f"{same} {rest('TWO')}!")]
    assert {r.doc_id: r.root for r in C.duplicate_roots(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1: 1, 2: 2, 3: 2}
