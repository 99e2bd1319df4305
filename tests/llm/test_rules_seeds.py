"""The rule ledger against plain counting and DuckDB, and decontamination against all alignments."""

import itertools
import random
import time
import re

import pytest

from corpusloom.llm import decontaminate, queries, rule_ledger
from corpusloom.llm.common import documents
from tests.oracle_check import compare, connect


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(lines), sum("A" <= c <= "Z" for c in text),
    )


def test_measures_of_odd_rows(spark, odd_texts):
    more = ["a b c d e f a b c d e", "x x x x x x", "A # * | <b>\nA # * | <b>\n\n\n", "a b c d e", "a b c d", "\n", "  lead\n lead", "é\x85 é\x0bz"]
    rows = list(enumerate(odd_texts + more)) + [(3, odd_texts[3]), (None, "no id")]
    table = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n_words int, failed string")
    found = rule_ledger.measure(table).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((d, *plain_measures(t)) for d, t in rows), key=repr)
    assert rule_ledger.ledger(table.limit(0)).count() == 0


def test_policies_and_ablations(spark, sf_dir):
    entries = rule_ledger.ledger(documents(spark, sf_dir)).persist()
    failed = [r.failed for r in entries.collect()]
    for policy in rule_ledger.POLICIES:
        mask = rule_ledger.policy_mask(policy)
        kept = rule_ledger.apply_policy(entries, policy).filter("kept").count()
        assert kept == sum(f & mask == 0 for f in failed)
        for r in rule_ledger.ablations(entries, policy).collect():
            bit = rule_ledger.BITS[r.rule]
            assert (r.fails, r.kept_without) == (sum(f & bit > 0 for f in failed), sum(f & mask == bit for f in failed))
    entries.unpersist()


def test_ledger_stays_in_the_engine(spark, sf_dir):
    plan = queries.QUERIES["op4_rule_ledger"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_ledger_equals_sql(spark, sf_dir):
    con = connect(sf_dir)
    assert compare(spark, con, "op4", queries.QUERIES["op4_rule_ledger"], queries.ORACLE["op4_rule_ledger"], sf_dir) is None


def test_masks_hit_every_accepted_overlap():
    for size in range(decontaminate.LEAST, decontaminate.WINDOW + 1):
        allowed = size - -int(-(decontaminate.SIMILARITY * size - 1e-9) // 1)
        hits = [{p + j for j in m} for m in decontaminate.MASKS for p in range(size - m[-1])]
        for gone in itertools.combinations(range(size), allowed):
            assert any(not h & set(gone) for h in hits)


def plain_overlaps(rows, items, window=13, similarity=0.8):
    """(doc_id, item_id, most equal tokens on a shift) over all shifts."""
    out = {}
    for k, (d, text) in enumerate(rows):
        t = decontaminate.tokens((text or "").encode())
        for item_id, passage in items:
            p = decontaminate.tokens((passage or "").encode())
            size = min(window, len(p))
            if len(p) < 8:
                if p and any(t[i : i + size] == p for i in range(len(t) - size + 1)):
                    out[k, item_id] = size
                continue
            for shift in range(-len(p) + size, len(t) - size + 1):
                equal = [0 <= i - shift < len(p) and t[i] == p[i - shift] for i in range(max(0, shift), min(len(t), shift + len(p)))]
                if any(sum(equal[i : i + size]) >= similarity * size - 1e-9 for i in range(len(equal) - size + 1)):
                    out[k, item_id] = max(out.get((k, item_id), 0), sum(equal))
    return sorted(((rows[k][0], i) for k, i in out), key=repr)


@pytest.fixture(scope="module")
def leaks(odd_texts):
    chance = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "ent", "or", "ing", "u", "ie")]
    items = [(i, " ".join(chance.choice(vocabulary) for _ in range(n))) for i, n in enumerate([8, 9, 11, 13, 15, 20, 40, 55, 7, 3, 0])]
    items += [(11, None), (12, items[6][1]), (6, items[6][1]), (None, " ".join(chance.choice(vocabulary) for _ in range(30)))]
    rows = [(i, t) for i, t in enumerate(odd_texts[:20])]
    for k in range(60):
        item = chance.choice(items)[1] or "none"
        words = item.split() or ["none"]
        part = words[chance.randrange(max(1, len(words) // 3)) :]
        for _ in range(chance.randint(0, max(1, len(part) // 4))):
            part[chance.randrange(len(part))] = "other"
        text = " ".join(chance.choice(vocabulary) for _ in range(30)) + " " + " ".join(part).upper() + ", " + chance.choice(vocabulary)
        rows.append((100 + k, text))
    return rows + [(100, rows[-1][1]), (None, items[7][1]), (900, None), (901, "")], items


def test_overlaps_of_odd_rows(spark, leaks):
    rows, items = leaks
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, seed string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, tokens int")
    found = decontaminate.contaminated(docs, bench)
    assert sorted({(r.doc_id, r.item_id) for r in found.collect()}, key=repr) == sorted(set(plain_overlaps(rows, items)), key=repr)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - len({(d, t) for d, t in rows if plain_overlaps([(d, t)], items)}) - 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("piece", [2048, 5])
def test_long_stretches_are_cut(spark, leaks, monkeypatch, piece):
    """One item many times over in one text, beside others: the same overlaps however it is cut."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    _, items = leaks
    items = [i for i in items if i[0] in (0, 3, 6, 7)]
    chance = random.Random(9)
    texts = [" ".join([items[1][1]] * 40), " ".join([items[2][1], items[0][1]] * 6), " ".join(items[3][1].split()[5:] * 3)]
    for _ in range(6):
        words = " ".join(chance.choice(items)[1] for _ in range(9)).split()
        for _ in range(20):
            words[chance.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in found}) == sorted(set(plain_overlaps(rows, items)))
    split = {d: decontaminate.tokens(t.encode()) for d, t in rows}
    for r in found:
        assert 0 <= r.first_token < r.end_token <= len(split[r.doc_id]) and 0 < r.n_equal <= r.end_token - r.first_token


def test_one_repeated_item_costs_in_proportion(spark):
    words = [f"w{i}" for i in range(13)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    seconds = []
    for times in (1000, 1000, 8000):  # the first run warms up; 8000 are 290 kB
        docs = spark.createDataFrame([(5, " ".join(words * times))], "doc_id long, text string")
        started = time.perf_counter()
        assert [(r.item_id, r.n_equal) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 13)]
        seconds.append(time.perf_counter() - started)
    assert seconds[2] < max(5.0, 8 * seconds[1])


def test_short_items_are_found_whole(spark):
    items = [(n, " ".join(f"s{n}{j}" for j in range(n))) for n in range(1, 8)] + [(20, "!! ??"), (21, "")]
    rows = [(n, f"before {text} behind, and {text} again") for n, text in items[:7]]
    rows += [(100 + n, " ".join(text.split()[:-1] + ["other"])) for n, text in items[:7]] + [(200, items[2][1].upper() + "!"), (201, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted(tuple(r)[:2] + tuple(r)[3:] for r in decontaminate.contaminated(docs, bench).collect())
    assert found == [(n, n, 1, 1 + n, n) for n in range(1, 8)] + [(200, 3, 0, 3, 3)]


def test_registered_decontamination(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    words = {w for _, t in items for w in decontaminate.tokens(t.encode())}
    near = [r for r in rows if sum(w in words for w in decontaminate.tokens(r[1].encode())) >= 6]
    found = queries.QUERIES["op3_decontaminate"](spark, sf_dir).collect()
    small = [r for r in near if len(r[1]) < 3000][:60]
    ids = {d for d, _ in small}
    assert sorted((r.doc_id, r.item_id) for r in found if r.doc_id in ids) == plain_overlaps(small, items)
