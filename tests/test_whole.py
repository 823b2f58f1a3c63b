"""Queries over whole tables, against plain Python on a small fixture."""

import datetime as dt
from collections import Counter

import pytest

from tallyforge import catalog
from tallyforge.plans import ingest_run, q_domain
from tallyforge.plans.views import Views

EVENTS = [(k, k % 6, dt.datetime(2024, 1, 1 + k // 6 % 28, k % 24), ("click", "purchase", "error", "view")[k % 4]) for k in range(400)]
DOCS = [(k, f"text {k}", "web") for k in range(1, 61)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put("events", EVENTS, "event_id long, user_id long, ts timestamp, event_type string")
    put("documents", DOCS, "doc_id long, text string, source string")
    put("part", [(k, k % 50, f"part {k}") for k in range(1, 900)], "p_partkey long, p_size int, p_name string")
    put("nation", [(k, f"N{k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int")
    return path


def rows(spark, sf, name):
    return Counter(map(tuple, catalog.queries()[name](spark, sf).collect()))


def attempts():
    return [(e, u, e * 7919 % 25, kind != "error", u * 100 + ts.day) for e, u, ts, kind in EVENTS if kind != "view"]


def test_advice_context_of_every_session(spark, sf):
    wrong = Counter((u, q) for _, u, q, ok, _ in attempts() if not ok)
    want = Counter((s, f"part {q}", f"N{q % 12}", wrong.get((u, q))) for _, u, q, _, s in attempts() if q)
    got = catalog.queries()["p35_advice_context"](spark, sf).select("session_id", "stem", "name", "error_count").collect()
    assert Counter(map(tuple, got)) == want and {s % 50 for s, *_ in want} != {1}


def test_answers_of_every_session(spark, sf):
    sessions = {}
    for _, _, q, _, s in sorted(attempts()):
        sessions.setdefault(s, []).append(q)
    options = lambda q: f"A=part {q}|B=none" if q % 5 == 0 else "A=A|B=B|C=C|D=D" if q % 2 == 0 else ""
    # every session in progress, questions of points that its learner may practise
    want = Counter((s, pos, q, f"part {q}", q % 50 % 5 + 1, options(q), f"f{q}" if q % 5 == 0 else "") for s, qs in sessions.items() for pos, q in enumerate(qs) if q and s % 4 == 1 and (q % 12 + s // 100) % 3)
    assert rows(spark, sf, "p33_answer_view") == want and len(want) > 20


def test_results_of_every_session(spark, sf):
    shown = {}
    for _, u, q, ok, s in sorted(attempts()):
        if q and s % 4 != 1 and (q % 12 + u) % 3:
            shown.setdefault(s, []).append((q, ok))
    got = {r["session_id"]: r for r in catalog.queries()["p34_result_view"](spark, sf).collect()}
    assert {s: [tuple(map(int, x.split(":")[:2])) for x in r["attempts"].split(",")] for s, r in got.items()} == {s: [(q, int(ok)) for q, ok in x] for s, x in shown.items()}
    assert all(r["right_answers"] == sum(ok for _, ok in shown[s]) for s, r in got.items())


def test_ingestion_of_every_upload(spark, sf):
    ids = [d for d, *_ in DOCS]
    fate = {d: ingest_run.stub_points(f"text {d}") for d in ids}
    called = {d: x["ok"] for d, x in fate.items()}
    found = {d: x["ok"] and "Points" in x["text"] for d, x in fate.items()}
    want = Counter((d, "succeeded" if found[d] else "failed", 1, int(found[d]), int(not found[d]), 2 * found[d], None if found[d] else "all pages failed") for d in ids)
    assert rows(spark, sf, "p26_point_ingestion") == want and 0 < sum(not x for x in called.values()) < len(ids)
    assert rows(spark, sf, "p27_resource_ingestion") == Counter(x for d in ids for x in ((d, "common_mistake"), (d, "concept_explanation")))
    assert rows(spark, sf, "p43_analysis_entry") == Counter((d, 2) for d in ids)


def test_source_of_every_upload(spark, sf):
    sources = [d for d, *_ in DOCS if d % 4 == 0]
    done = {d % 48 for d in sources if d % 3 == 1}
    first = {}
    for d in sources:
        if d % 48 not in done:
            first.setdefault(d % 48, d)
    assert rows(spark, sf, "p30_source_once") == Counter(first.items()) and len(first) > 3


def test_materials_of_every_session(spark, sf):
    points = {(s, k) for _, _, q, _, s in attempts() if q for k in (q % 12, (q * 7 + 5) % 25)}
    of = lambda k: [d for d, *_ in DOCS if d % 25 == k]
    want = Counter((s, k, len(of(k)), max(of(k), key=lambda d: d % 1000)) for s, k in points if of(k))
    assert rows(spark, sf, "j8_array_key_join") == want


def test_history_of_twenty_sessions(spark, sf):
    found = {}
    for e, u, _, ok, s in attempts():
        found.setdefault((u, s), []).append((EVENTS[e][2], ok))
    want = Counter()
    for user in range(6):
        mine = sorted(((max(t for t, _ in x), s, x) for (u, s), x in found.items() if u == user), reverse=True)[:20]
        want.update((user, s, min(t for t, _ in x), at, len(x), sum(ok for _, ok in x), int(100 * sum(ok for _, ok in x) / len(x) + 0.5)) for at, s, x in mine)
    assert rows(spark, sf, "p21_session_history") == want and len(want) > 100


def test_question_list(spark, sf):
    first = sorted(range(1, 900), key=lambda q: (q % 12, -(q % 50), q))[:500]
    got = catalog.queries()["p38_question_list"](spark, sf).collect()
    assert Counter((r["kp_id"], r["question_id"], r["subject_id"]) for r in got) == Counter((q % 12, q, q % 12 % 5 % 2) for q in first)
    kept = q_domain.question_list(Views(spark, sf), subject=1).collect()
    assert Counter(r["question_id"] for r in kept) == Counter(q for q in first if q % 12 % 5 % 2 == 1)


def test_question_list_takes_options_from_staging(spark, sf):
    v = Views(spark, sf)
    v.staging = spark.createDataFrame([(1, "question", 12, '{"options":[{"label":"A"}]}'), (2, "question", 12, '{"options":[{"label":"B"}]}'), (3, "question", 12, '{"options":[]}'), (4, "material", 24, '{"options":[1]}')], "staging_id long, entity_kind string, published_id long, payload string")
    got = {r["question_id"]: r["options"] for r in q_domain.question_list(v).collect()}
    assert got[12] == '[{"label":"B"}]' and got[24] is None


def test_planner_input_has_six_scans(spark, sf):
    got = catalog.queries()["p4_planner_input"](spark, sf).collect()
    of = lambda scan: Counter((r["student_id"], r["kp_id"], r["question_id"], r["value"]) for r in got if r["scan"] == scan)
    unlocked = {(u, k) for u in range(6) for k in range(25) if (k + u) % 3}
    bank = {(u, q % 12, q) for u in range(6) for q in sorted((q for q in range(1, 900) if (u, q % 12) in unlocked), key=lambda q: (q % 12, q % 50, q))[:500]}
    assert max(Counter(u for u, *_ in bank).values()) == 500
    points = lambda q: (q % 12, (q * 7 + 5) % 25)
    bank = {x for x in bank if all((x[0], k) in unlocked for k in points(x[2]))}
    narrow = {(u, k) for u, k, _ in bank}
    bank = {x for x in bank if all((x[0], k) in narrow for k in points(x[2]))}
    assert of("bank") == Counter((u, k, q, None) for u, k, q in bank) and bank
    assert of("preference") == Counter((u, None, None, "auto" if u % 3 else "custom") for u in range(6))
    assert {x[:2] for x in of("point")} == {(u, k) for u, k in narrow if k % 5 % 2 == u % 2}
    log = {}
    for _, u, q, ok, _ in sorted(attempts()):
        log.setdefault((u, q), []).append(ok)
    tail = lambda x: len(x) - 1 - max(k for k, ok in enumerate(x) if not ok)
    open_ = {k: x for k, x in log.items() if not all(x) and tail(x) < 2 and k[1]}
    assert of("mistake") == Counter((u, q % 12, q, str(x.count(False))) for (u, q), x in open_.items() if (u, q % 12) in narrow) and len(of("mistake")) > 3
    seen = {(u, q % 12) for u, q in log if q} & narrow
    assert {x[:2] for x in of("mastery")} == seen and {x[:2] for x in of("due")} == seen


def test_titles_and_payloads_are_whole_texts(spark, tmp_path):
    texts = ["the same twenty letters, then one end", "the same twenty letters, then another", "the same twenty letters, then one end", 'a "quoted" \\ line\n{"b": 1} end', None]
    spark.createDataFrame([(k, t, "web") for k, t in enumerate(texts, 1)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(spark, tmp_path, "x3_keyed_dedupe") == Counter([(1,), (2,), (4,), (5,)])
    named = {r["staging_id"]: r["name"] for r in catalog.queries()["n6_staging_projection"](spark, str(tmp_path)).collect()}
    assert named == dict(enumerate(texts, 1))
