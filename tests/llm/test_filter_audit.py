import re
from collections import Counter
from itertools import permutations
from math import factorial

from oracle import connect, duck_rows, normal, spark_rows  # noqa: F401
from pyspark.sql import functions as F

from gleaner.llm import filter_audit


def failures(docs, words):
    """Letters of the filters each row (id, text) fails."""
    least = {}
    for i, text in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text in docs:
        text = text or ""
        w = words(text)
        failed = "A" if len(w) < 50 else ""
        failed += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
        failed += "D" if re.search(r"[#$%&*|]", text) else ""
        failed += "E" if i is not None and text in least and least[text] < i else ""
        out.append(failed)
    return out


def walked(rows, labels, words):
    """(part, order, step) -> the eight counts, every order walked document by document."""
    failed = failures([(i, t) for i, t, _ in rows], words)
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, failed, strict=True) if (s or "") == part]
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                share[letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f for _, f in mine) - len(gone), sum(f == letter for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = share[row[-1]]
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def corpus(odd_rows):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(r[0], r[1], r[3]) for r in odd_rows] + [(20, "", None), (21, None, ""), (22, "same", "z"), (23, "same", "y"), (24, "same", "z")]
    rows += [(30 + k, text, "hot") for k in range(40)] + [(None, text, "hot"), (None, text, "hot"), (None, "lonely", "y"), (None, "lonely", "y")]
    rows += [(80, text + " #", "hot"), (81, text.upper(), "hot"), (82, "A " * 100, "hot"), (82, "A " * 100, "hot")]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(1, 83)] + [(5, 1, 1), (6, None, None), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def tables(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for name in "part failed hash n good bad toxic q c first least step filter_order".split():
        docs = docs.withColumn(name, F.lit("x"))
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit("x"))


def test_equals_walking_every_order(spark, odd_rows, brute):
    rows, labels = corpus(odd_rows)
    for parts in (1, 6):
        docs, marks = tables(spark, rows, labels)
        assert found(filter_audit.audit_documents(docs.repartition(parts), marks)) == walked(rows, labels, brute.words)


def test_empty_tables(spark, odd_rows, brute):
    rows, labels = corpus(odd_rows)
    docs, marks = tables(spark, rows, labels)
    assert filter_audit.audit_documents(docs.where("1 = 0"), marks).collect() == []
    assert found(filter_audit.audit_documents(docs, marks.where("1 = 0"))) == walked(rows, [], brute.words)


def test_potential_by_its_definition(spark):
    """Shares from the potential equal average marginal worths, for any worths of coalitions."""
    worth = [0, 7, 3, 9, 4, 11, 8, 12]
    df = spark.createDataFrame([(worth,)], "w array<bigint>")
    q = df.select(filter_audit.potentials(F.col("w"), 3).alias("q")).first()["q"]
    for k in range(3):
        total = 0
        for order in permutations(range(3)):
            before = sum(1 << f for f in order[: order.index(k)])
            total += worth[before + (1 << k)] - worth[before]
        assert q[7] - 3 * q[7 - (1 << k)] == total
    assert sum(q[7] - 3 * q[7 - (1 << k)] for k in range(3)) == factorial(3) * worth[7]


def test_plan_has_no_python_and_no_cross_join(spark, odd_rows):
    rows, labels = corpus(odd_rows)
    plan = filter_audit.audit_documents(*tables(spark, rows, labels))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))
