"""Terminal sessions, and what pages are, by literal cases."""

import pytest

from frameloom.operators import parsers, terminals

LINE = "stream string, frame long, idx long, text string, confidence double, y double"


@pytest.mark.parametrize(
    "at, before, to, now",
    [("~", "~", "src", "~/src"), ("~/src", "~", "..", "~"), ("~", "~", "..", "~"), ("/", "~", "..", "/"), ("~/a", "~", "../b/./c", "~/b/c"), ("~/a", "/x", "-", "/x"), ("/x/y", "~", "", "~"), ("/x/y", "~", "~", "~"), ("/x", "~", "~/a/../b", "~/b"), ("~/q", "~", "/var/log/", "/var/log"), ("~", "~", "/", "/"), ("/", "~", "etc", "/etc")],
)
def test_directories(at, before, to, now):
    assert terminals.moved(at, before, to) == now


def test_a_terminal_session(spark):
    said = ["Last login: Mon", "$ cd src", "$ git status", "nothing to commit", "$ make all", "gcc -c a.c", "error: no such file", "   ", "$ sudo cd /srv", "$ ls -la", "total 4", "logout", "$ git push", "done"]
    lines = spark.createDataFrame([("t", 10 * k, k, s, 0.9, 0.0) for k, s in enumerate(said)] + [("u", 0, 0, "no command here", 0.9, 0.0), (None, 0, 0, "$ git pull", 0.9, 0.0)], LINE).repartition(3)
    done = terminals.executions(lines)
    found = sorted((tuple(r) for r in done.collect() if r["stream"] == "t"), key=lambda r: r[4])
    assert [(r[1], r[2], r[5], r[6], r[7], r[8]) for r in found] == [
        (1, 1, "cd", "~", 0, False), (1, 2, "git", "~/src", 1, False), (1, 3, "make", "~/src", 2, True), (1, 4, "cd", "~/src", 0, False), (1, 5, "ls", "/srv", 2, False), (2, 1, "git", "~", 1, False),
    ]
    first = terminals.sessions(done).where("stream = 't' and session = 1").first()
    assert (first["commands"], first["error_rate"], first["directory"], first["start"], first["end"], first["n_output"]) == (5, 0.2, "/srv", 10, 90, 5)
    assert {r["stream"] for r in done.collect()} == {"t", None} and terminals.executions(lines.limit(0)).count() == 0


def test_repeated_sequences(spark):
    said = ["$ git add", "$ git commit", "$ git add", "$ git commit", "$ make", "$ git add"]
    done = terminals.executions(spark.createDataFrame([("t", k, k, s, 0.9, 0.0) for k, s in enumerate(said)], LINE))
    assert {(tuple(r["sequence"]), r["n"]) for r in terminals.repeated_sequences(done).collect()} == {(("git", "git"), 3)}


@pytest.mark.parametrize(
    "url, form, content, kind, app, detail, route",
    [
        ("https://shop.a.com/list/books", False, "", "homepage", "ecommerce", "books", None), ("https://a.com/product/7", True, "", "product_page", "ecommerce", None, None), ("https://www.linkedin.com/feed", False, "Article", "article", "social_media", "LinkedIn", None),
        ("https://x.atlassian-jira.com/#/board/7", False, "", "spa", "productivity", "Jira", "board/7"), ("https://a.pipedrive.com/#!/deals", False, "", "spa", "crm", "Pipedrive", "deals"), ("https://a.pipedrive.com/#!/deals", True, "", "form", "crm", "Pipedrive", None),
        ("https://docs.vuejs.org/", False, "A catalog", "listing", "documentation", "vue", None), ("https://a.com/docs/x", False, "", "homepage", "documentation", None, None), ("https://github.com/a", False, "", "homepage", None, None, None), ("https://amazon.com/cart", False, "", "checkout", "ecommerce", None, None),
        ("https://a.com/x?q=1", False, "", "search_results", None, None, None), ("https://a.com/signin", True, "", "login", None, None, None), ("https://a.com/404", False, "blog", "error", None, None, None),
    ],
)
def test_pages(spark, url, form, content, kind, app, detail, route):
    host = url.split("/")[2]
    r = parsers.pages(spark.createDataFrame([(1, url, host, form, content)], "page_id long, url string, host string, has_form boolean, content string")).first()
    assert (r["page_type"], r["application"], r["detail"], r["route"]) == (kind, app, detail, route)


def test_breadcrumbs(spark):
    rows = [("s", 1, 0, "Welcome"), ("s", 1, 1, "Home > Shop > Books/Used"), ("s", 1, 2, "a/b"), ("s", 2, 0, " a / b //"), ("s", 3, 0, "x › y"), ("s", 4, 0, "x » y")]
    found = {(r["frame"], r["idx"], tuple(r["crumbs"])) for r in parsers.breadcrumbs(spark.createDataFrame(rows, "stream string, frame long, idx long, text string")).collect()}
    assert found == {(1, 1, ("Home", "Shop", "Books/Used")), (2, 0, ("a", "b")), (3, 0, ("x", "y"))}
