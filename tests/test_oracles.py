import itertools
import math
import re
from html import unescape

import compare
import pytest
from test_scans import crawl_by_hand

import __spark_entry__ as entry
from fathom.functions import words
from fathom.operators import regimes as R
from fathom.plans import queries as Q
from fathom.sources import pages as P

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def paragraphs(text):
    """Blocks between blank lines, or groups of sentences that close at 260 characters."""
    text = (text or "").strip()
    found = [p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()]
    if len(found) <= 1:
        found, held = [], []
        for s in filter(None, re.split(r"(?<=[.!?])\s+", text)):
            held.append(s)
            if sum(len(x) + 1 for x in held) >= 260:
                found.append(" ".join(held))
                held = []
        found += [" ".join(held)] if held else []
    return [p for p in found if len(p) >= 60]


def check_paragraphs(rows, con):
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    want = [(i, k, p) for i, t in docs for k, p in enumerate(paragraphs(t))]
    assert sorted((r["doc_id"], r["paragraph_idx"], r["paragraph_text"]) for r in rows) == sorted(want)
    assert all(r["weak_labels"] == [k for k, some in Q.TOPICS.items() if any(w in r["paragraph_text"].lower() for w in some)] for r in rows)


def check_listing(rows, con):
    """Against regular expressions: the anchors of these pages hold text only."""
    html = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    want = set()
    for page, text in html.items():
        for href, title in re.findall(r'<a href="([^"]*)"[^>]*>([^<]*)</a>', text):
            if len(unescape(title).strip()) >= 5 and href.endswith(".html") and not any(x in href for x in P.NO_ARTICLE):
                want.add((page, href if href.startswith("http") else "https://site.com" + href))
    assert {(r["page_id"], r["url"]) for r in rows} == want and len(rows) == len(want)


def check_pages(rows, con):
    html = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    plain = lambda x: "".join(unescape(re.sub(r"<[^>]*>", "", x)).split())
    assert {r["page_id"] for r in rows} == set(html) and len(rows) == len(html)
    for r in rows:
        nav = re.search(r"(?s)<nav>(.*?)</nav>", html[r["page_id"]])
        crumbs = [unescape(a).strip() for a in re.findall(r"<a [^>]*>([^<]*)</a>", nav[1] if nav else "")]
        assert r["section"] == (" > ".join([c for c in crumbs if c][-3:]) or None)
        title = re.search(r"(?s)<h1[^>]*>(.*?)</h1>", html[r["page_id"]])
        assert plain(r["title"] or "") == (plain(title[1]) if title else "")
        whole = " ".join(plain(p) for p in re.findall(r"(?s)<p(?=[ >])[^>]*>(.*?)(?=</p>|<p[ >]|</article>|</div>|</main>|</section>|</body>)", html[r["page_id"]]))
        assert all(len(p) >= 40 and plain(p) in whole for p in filter(None, r["body"].split("\n")))


def check_probabilities(prefix, label):
    def check(rows, con):
        known = [r.asDict() for r in rows if r[label] is not None]
        assert len(known) > 0.9 * len(rows)
        for r in known:
            probs = {k.removeprefix(prefix): p for k, p in r.items() if k.startswith(prefix)}
            assert math.isclose(sum(probs.values()), 1, abs_tol=1e-6) and str(r[label]) in probs
        # smoothed probabilities agree with the path nearly everywhere
        assert sum(max((p, k) for k, p in r.items() if k.startswith(prefix))[1] == f"{prefix}{r[label]}" for r in known) > 0.9 * len(known)

    return check


def check_forecasts(rows, con):
    assert rows and len({r["date"] for r in rows}) == len(rows)
    price = dict(con.execute(f"WITH price AS ({Q.X.SQL['price']}), ret AS ({Q.X.SQL['ret']}) SELECT date, ret FROM ret").fetchall())
    assert all(math.isclose(r["y_true"], price[r["date"]], abs_tol=1e-6) and math.isfinite(r["y_pred"]) for r in rows)
    spread = (max(r["y_true"] for r in rows) - min(r["y_true"] for r in rows)) * 3
    assert all(abs(r["y_pred"]) < spread for r in rows)
    if "hit" in rows[0]:
        growth = 1.0
        for r in sorted(rows, key=lambda r: r["date"]):
            growth *= 1 + (r["y_pred"] > 0) * r["y_true"] / 100 - (r["y_pred"] < 0) * r["y_true"] / 100
            assert r["hit"] == ((r["y_true"] > 0) == (r["y_pred"] > 0)) and math.isclose(growth, r["cum_strategy_ret"] + 1, rel_tol=1e-6)


def check_importance(rows, con):
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and len({r["feature"] for r in rows}) == len(rows)
    assert all(a["importance"] >= b["importance"] for a, b in itertools.pairwise(sorted(rows, key=lambda r: r["rank"])))


def check_topics(rows, con):
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    found = [set(filter(None, r["topics"].split(","))) for r in rows]
    assert set().union(*found) <= set(words.TOPIC_KEYWORDS) and any(found)
    assert all(r["topics"] == ",".join(sorted(s)) for r, s in zip(rows, found, strict=True))


def check_expanded(rows, con):
    assert rows and {r["group"] for r in rows} <= {"one", "two", "three"} and len({(r["group"], r["word"]) for r in rows}) == len(rows)
    known = {"the", "that", "with", "der", "und", "nicht", "que", "les", "dans"}
    assert all(r["similarity"] >= 0.3 and r["mean_cosine"] >= 0.2 and r["mean_pmi"] >= 0.02 and r["word"] not in known and r["similar_to"] in known for r in rows)


def check_crawl(rows, con):
    cards = con.execute("SELECT coalesce(lang, 'none'), ((doc_id // 4) % 14 + CASE WHEN doc_id % 14 > 8 THEN 2 ELSE 1 END)::INT, 'u' || (CASE WHEN doc_id % 5 = 0 THEN doc_id // 10 ELSE doc_id END), coalesce(source, '') FROM documents").fetchall()
    assert sorted((r["category"], r["page"], r["url"], r["headline"]) for r in rows) == crawl_by_hand(cards, ["en", "de", "fr", "es"], 15)


def check_tuned(rows, con):
    (r,) = rows
    assert r["reset"] in (0.2, 0.35, 0.5) and all(m in (0.7, 0.85, 1.0, 1.15, *R.MULTIPLIERS.values()) for m in r["multipliers"]) and len(r["multipliers"]) == 4
    assert r["whole"] in range(3) and len(r["experts"]) == 4 and all(e in range(3) for e in r["experts"])


def check_report(rows, con):
    """Weeks and means as inferred, and each state's moves, for each of four regimes."""
    found = {(r["regime"], r["measure"]): r["value"] for r in rows}
    states = {k for k, m in found if m == "decay_weeks"}
    assert states == set(R.REGIMES) and all(abs(sum(found[k, f"to {n}"] for n in states) - 1) < 0.01 for k in states)
    seen = {k for k, m in found if m == "n_weeks"}
    assert seen <= states and sum(found[k, "n_weeks"] for k in seen) > 100
    assert all(found[k, f"seen {c}"] is not None and found[k, f"state {c}"] is not None for k in seen for c in Q._DRIVERS)


def check_states(rows, con):
    assert rows and all(sum(r[f"hmm_regime_{k}_lag1"] for k in range(3)) == 1 for r in rows)


#: What rows must hold where SQL can't say it.
CHECKS = {
    "F11_M4_paragraphs": check_paragraphs, "S18_articles": check_pages, "R2_R5_R6_markov_regime": check_probabilities("hmm_prob_", "hmm_regime"),
    "R3_R4_R11_driver_regime": check_probabilities("regime_prob_", "regime"), "W18_ridge_walk_forward": check_forecasts, "B7_boosted_walk_forward": check_forecasts,
    "B1_B2_B3_B6_regime_walk_forward": check_forecasts, "B9_specialist_walk_forward": check_forecasts, "B11_L7_permutation_importance": check_importance,
    "B5_nested_tuning": check_tuned, "M9_M10_M11_expanded_groups": check_expanded, "R7_driver_report": check_report, "R2_R5_R6_markov_regime_of_events": check_probabilities("hmm_prob_", "hmm_regime"), "S17_listing": check_listing, "S20_crawl": check_crawl,
    "M5_M6_J13_A12_article_topics": check_topics, "X1_feature_matrix_with_states": check_states,
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0].isupper()))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare.difference(df, con, ORACLES[name]) is None
    else:
        CHECKS[name](df.collect(), con)


def test_states_only_add_columns(spark):
    plain, more = (QUERIES[n](spark, FOLDER) for n in ("X1_feature_matrix", "X1_feature_matrix_with_states"))
    assert sorted(plain.collect()) == sorted(more.select(plain.columns).collect())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "close_pct_change" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
