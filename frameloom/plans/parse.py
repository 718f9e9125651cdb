"""Application parsers as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, kernels, parsers, terminals
from ..sources import adapters as A
from .registry import query
from .sequence import NUMBERED

EV, RG, VS = A.EVENTS_SQL, A.REGIONS_SQL, A.VISITS_SQL
SCREENS = f"{A.SCREENS_SQL}, {A.read_sql('sc', 'family')}"
TERMINAL = f"{A.TERMINAL_SQL}, {A.read_sql('tm')}"
PLAIN = f"{RG}, {A.read_sql('rg')}"
LINES = f"{TERMINAL}, co AS (SELECT stream, frame, idx, cmd, said FROM re WHERE {parsers.COMMAND_LINE.replace('regexp_like(', 'regexp_matches(')})"


def _sql(test: str) -> str:
    return test.replace("regexp_like(", "regexp_matches(")


def _names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("x_elements", f"WITH {SCREENS} {parsers.elements_sql('re')}")
def x_all(spark, d):
    return parsers.elements(A.screens(spark, d), "app").drop("text")


@query("x_element_counts", f"WITH {SCREENS} SELECT family, semantic_type, count(*) AS n FROM ({parsers.elements_sql('re')}) GROUP BY ALL")
def x_counts(spark, d):
    return parsers.elements(A.screens(spark, d), "app").groupBy("family", "semantic_type").agg(F.count("*").alias("n"))


@query("x4_terminal_elements", f"WITH {TERMINAL} {parsers.elements_sql('re', ('terminal',))}")
def x4(spark, d):
    return parsers.elements(A.terminal(spark, d), families=("terminal",)).drop("text")


LABELS = "(right(trim(text), 1) = ':' OR length(trim(text)) < 50)"
PAIRS = f"""{RG}, tx AS (SELECT *, {LABELS} AS label FROM rg WHERE trim(text) <> ''), pa AS (SELECT a.stream, a.frame, a.idx, b.idx AS b_idx, trim(trim(a.text), ': ') AS label, trim(b.text) AS value, least(a.confidence, b.confidence) AS confidence FROM tx a JOIN tx b ON a.stream = b.stream AND a.frame = b.frame AND b.idx > a.idx
 WHERE a.label AND NOT b.label AND (b.x + b.w / 2 > a.x + a.w / 2 OR b.y + b.h / 2 > a.y + a.h / 2) QUALIFY row_number() OVER (PARTITION BY a.stream, a.frame, a.idx ORDER BY pow(b.x + b.w / 2 - a.x - a.w / 2, 2) + pow(b.y + b.h / 2 - a.y - a.h / 2, 2), b.idx) = 1)"""


@query("x1_fields", f"""WITH {PAIRS}, l AS (SELECT *, lower(label) AS low FROM pa) SELECT stream, frame, idx, b_idx, label, value, confidence, CASE WHEN {parsers.ASSIGNED} THEN {parsers.words(*parsers.ASSIGNMENTS, otherwise='assignment')} END AS assignment,
 CASE WHEN {parsers.RECORD_FIELD} THEN {parsers.words(*parsers.RECORD_TYPES, otherwise='text')} END AS record_type FROM l""")
def x1(spark, d):
    r = A.regions(spark, d).where(F.trim("text") != "")
    return parsers.fields(kernels.nearest_later(r, F.expr(LABELS), ("text", "confidence")))


@query("x2_base_events", f"""WITH {NUMBERED}, de AS (SELECT stream, seq, idx, 'modified' AS change FROM mt WHERE text <> b_text UNION ALL SELECT stream, seq, idx, 'added' FROM nb WHERE seq > 1 AND (stream, seq, idx) NOT IN (SELECT stream, seq, idx FROM mt))
SELECT stream, frame, idx, CASE change WHEN 'modified' THEN 'field_change' ELSE 'content_added' END AS type, 'field_' || x::INT || '_' || y::INT AS target, trim(text) AS value, confidence,
 CASE change WHEN 'modified' THEN 'data_modification' ELSE 'data_creation' END AS category, CASE change WHEN 'modified' THEN 'medium' ELSE 'low' END AS importance FROM de JOIN nb USING (stream, seq, idx) WHERE trim(text) <> '' AND right(trim(text), 1) <> ':'""")
def x2(spark, d):
    n = joins.with_previous_frame(A.regions(spark, d))
    return parsers.base_events(joins.delta(n), n)


@query("x3_commands", f"WITH {LINES} SELECT stream, frame, idx, cmd AS command, {parsers.pick(*((f'cmd IN {_names(n.split())}', k) for n, k in parsers.COMMAND_KINDS), otherwise='other')} AS kind, said[1] = 'sudo' AS sudo, said[(CASE WHEN said[1] = 'sudo' THEN 3 ELSE 2 END):] AS arguments FROM co")
def x3(spark, d):
    return parsers.commands(A.terminal(spark, d)).select("stream", "frame", "idx", "command", "kind", "sudo", "arguments")


@query("x9_workflow_patterns", f"""WITH {LINES}, la AS (SELECT stream, frame, idx, list(cmd) OVER (PARTITION BY stream ORDER BY frame, idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM co),
fo AS (SELECT stream, frame, idx, unnest(list_filter([CASE WHEN len(list_filter(l, lambda x: x = 'git')) >= 2 THEN 'git_workflow' END, CASE WHEN len(list_filter(l, lambda x: x IN {_names(parsers.BUILDS)})) >= 1 THEN 'build_workflow' END, CASE WHEN len(list_distinct(list_filter(l, lambda x: x IN {_names(parsers.FILE_COMMANDS)}))) >= 3 THEN 'file_management' END], lambda x: x IS NOT NULL)) AS pattern FROM la)
SELECT stream, pattern, frame, idx FROM fo QUALIFY row_number() OVER (PARTITION BY stream, pattern ORDER BY frame, idx) = 1""")
def x9(spark, d):
    return parsers.workflow_patterns(parsers.commands(A.terminal(spark, d)))


@query("m16_terminal_sessions", f"""WITH {LINES}, g AS (SELECT stream, count(*) AS commands, list(cmd) AS l FROM co GROUP BY 1) SELECT stream, commands, list_filter([CASE WHEN list_contains(l, 'git') AND list_has_any(l, ['npm', 'yarn']) THEN 'web_development' END, CASE WHEN list_has_any(l, ['docker', 'kubectl']) THEN 'containerization' END,
 CASE WHEN list_has_any(l, ['ssh', 'scp']) THEN 'remote_administration' END, CASE WHEN len(list_filter(l, lambda x: x IN {_names(parsers.EXPLORING)})) >= 3 THEN 'file_exploration' END], lambda x: x IS NOT NULL) AS patterns FROM g""")
def m16(spark, d):
    return parsers.session_patterns(parsers.commands(A.terminal(spark, d)))


@query("a24_terminal_metrics", f"""WITH {LINES} SELECT stream, count(*) AS commands, round(CASE WHEN max(frame) > min(frame) THEN count(*) / ((max(frame) - min(frame)) / 60) END, 6) AS per_minute, round(avg((cmd IN {_names(parsers.PRODUCTIVE)})::INT), 6) AS productivity, round(avg((said[1] = 'sudo')::INT), 6) AS sudo_share FROM co GROUP BY 1""")
def a24(spark, d):
    return parsers.terminal_metrics(parsers.commands(A.terminal(spark, d)))


def _like(value: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({value}, '{p}')" for p in parts) + ")"


def _detail(value: str, *parts: str, names: dict | None = None) -> str:
    return "CASE " + " ".join(f"WHEN contains({value}, '{p}') THEN '{(names or {}).get(p, p)}'" for p in parts) + " END"


#: Urls of all sorts, by the pages' numbers: the same in both engines.
URLS = ("https://shop.example.com/books/1", "https://www.facebook.com/x", "https://team.atlassian.net/jira/a#/board/7", "https://acme.my.salesforce.com/home", "https://docs.djangoproject.com/en", "https://e.com/product/9", "https://e.com/login", "https://e.com/find?q=a", "https://app.notion.so/#!/page/2", "https://api.e.com/docs/v1")
URL_SQL = "[" + ", ".join(f"'{u}'" for u in URLS) + "]"


@query("x13_pages", f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE {URL_SQL}[(page_id % 10 + 1)::INT] END AS url, contains(html, '<form') AS form, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS body FROM pages), l AS (SELECT *, lower(url) AS u, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h FROM p),
k AS (SELECT *, CASE WHEN regexp_matches(u, '/login|/signin') THEN 'login' WHEN regexp_matches(u, '/search|\\?q=') THEN 'search_results' WHEN regexp_matches(u, '/profile|/account') THEN 'user_profile' WHEN contains(u, '/dashboard') THEN 'dashboard' WHEN regexp_matches(u, '/checkout|/cart') THEN 'checkout' WHEN regexp_matches(u, '/product/|/item/') THEN 'product_page'
 WHEN regexp_matches(u, '/error|/404') THEN 'error' WHEN form THEN 'form' WHEN contains(url, '#/') OR contains(url, '#!/') THEN 'spa' WHEN regexp_matches(body, 'article|blog') THEN 'article' WHEN regexp_matches(body, 'list|catalog') THEN 'listing' ELSE 'homepage' END AS page_type FROM l)
SELECT page_id, page_type, CASE WHEN {_like('h', 'shop', 'store')} OR {_like('u', '/product', '/cart')} THEN 'ecommerce' WHEN {_like('h', 'facebook.com', 'twitter.com', 'linkedin.com', 'instagram.com')} THEN 'social_media' WHEN {_like('h', 'jira', 'confluence', 'trello', 'asana', 'notion')} THEN 'productivity' WHEN {_like('h', 'salesforce', 'hubspot', 'pipedrive')} THEN 'crm' WHEN contains(h, 'docs') OR contains(u, '/docs/') THEN 'documentation' END AS application,
 CASE WHEN {_like('h', 'shop', 'store')} OR {_like('u', '/product', '/cart')} THEN {_detail('u', 'electronics', 'clothing', 'books', 'home', 'sports', 'beauty')} WHEN {_like('h', 'facebook.com', 'twitter.com', 'linkedin.com', 'instagram.com')} THEN {_detail('h', 'facebook', 'twitter', 'linkedin', 'instagram', names={'facebook': 'Facebook', 'twitter': 'Twitter', 'linkedin': 'LinkedIn', 'instagram': 'Instagram'})}
 WHEN {_like('h', 'jira', 'confluence', 'trello', 'asana', 'notion')} THEN {_detail('h', 'jira', 'confluence', 'trello', 'asana', 'notion', names={'jira': 'Jira', 'confluence': 'Confluence', 'trello': 'Trello', 'asana': 'Asana', 'notion': 'Notion'})} WHEN {_like('h', 'salesforce', 'hubspot', 'pipedrive')} THEN {_detail('h', 'salesforce', 'hubspot', 'pipedrive', names={'salesforce': 'Salesforce', 'hubspot': 'HubSpot', 'pipedrive': 'Pipedrive'})}
 WHEN contains(h, 'docs') OR contains(u, '/docs/') THEN {_detail('h', 'react', 'vue', 'angular', 'django', 'rails', 'laravel')} END AS detail,
 CASE WHEN page_type = 'spa' THEN CASE WHEN contains(url, '#/') THEN url[strpos(url, '#/') + 2:] ELSE url[strpos(url, '#!/') + 3:] END END AS route FROM k""")
def x13(spark, d):
    n = F.col("page_id")
    p = A.table(spark, d, "pages").withColumn("url", F.when(n % 3 == 0, F.col("url")).otherwise(F.element_at(F.array(*map(F.lit, URLS)), (n % 10 + 1).cast("int"))))
    v = p.select("page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.contains("html", F.lit("<form")).alias("has_form"), F.regexp_replace("html", "<[^>]*>", " ").alias("content"))
    return parsers.pages(v).select("page_id", "page_type", "application", "detail", "route")


@query("x14_breadcrumbs", f"""WITH {VS}, f AS (SELECT host AS stream, page_id AS frame, 0 AS idx, trim(CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN replace(regexp_replace(url, '^https?://', ''), '/', ' > ') ELSE replace(regexp_replace(url, '^https?://', ''), '/', ' › ') END) AS t FROM vs)
SELECT stream, frame, idx, list_filter(list_transform(string_split(t, CASE WHEN contains(t, '>') THEN '>' WHEN contains(t, '/') THEN '/' ELSE '›' END), lambda p: trim(p, ' ')), lambda p: p <> '') AS crumbs FROM f WHERE contains(t, '>') OR contains(t, '/') OR contains(t, '›')""")
def x14_crumbs(spark, d):
    # addresses of the pages visited, written as trails of three sorts
    bare, n = F.regexp_replace("url", "^https?://", ""), F.col("page_id") % 3
    said = F.when(n == 0, bare).when(n == 1, F.replace(bare, F.lit("/"), F.lit(" > "))).otherwise(F.replace(bare, F.lit("/"), F.lit(" › ")))
    return parsers.breadcrumbs(A.visits(spark, d).select(F.col("host").alias("stream"), F.col("page_id").alias("frame"), F.lit(0).alias("idx"), said.alias("text")))


@query("x14_navigation_history", f"WITH {VS} SELECT page_id, list(url) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS history FROM vs")
def x14(spark, d):
    return parsers.navigation_history(A.visits(spark, d)).select("page_id", "history")


@query("x14_screen_structure", f"""WITH {PLAIN}, l AS (SELECT *, {parsers.FORM_LABEL} AS label, {parsers.FORM_BUTTON} AS button, {parsers.LINK} AS link, {_sql(parsers.HEADING)} AS heading FROM re)
SELECT stream, frame, count(heading) AS headings, count(*) FILTER (label) AS labels, count(*) FILTER (button AND NOT label) AS buttons, count(*) FILTER (link) AS links, coalesce(list(replace(lower(trim(t, ':*')), ' ', '_') ORDER BY y, idx) FILTER (label), []) AS fields,
 (min(struct_pack(y, idx, t)) FILTER (length(t) > 5 AND length(t) < 100 AND y < 200 AND NOT label AND NOT button)).t AS title FROM l GROUP BY 1, 2""")
def x14_screen(spark, d):
    return parsers.screen_structure(A.regions(spark, d))


@query("a25_page_structure", "SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]')) AS headings, len(regexp_extract_all(html, '(?i)<a[\\s>]')) AS links, len(regexp_extract_all(html, '(?i)<form[\\s>]')) AS forms, len(regexp_extract_all(html, '(?i)<button[\\s>]')) AS buttons, len(regexp_extract_all(html, '(?i)<li[\\s>]')) AS items, len(regexp_extract_all(html, '(?i)<p[\\s>]')) AS paragraphs FROM pages")
def a25(spark, d):
    return parsers.page_structure(A.table(spark, d, "pages"))


@query("x22_amounts", f"""WITH {RG}, f AS (SELECT stream, frame, idx, text, regexp_extract(text, '([$€£¥]\\s*[0-9][0-9,]*(?:\\.[0-9]+)?)', 1) AS sum, regexp_extract(text, '(\\d+)\\s*%', 1) AS p, regexp_extract(text, '(\\d+)\\s*/\\s*(\\d+)', 1) AS a, regexp_extract(text, '(\\d+)\\s*/\\s*(\\d+)', 2) AS b, regexp_extract(text, '(\\d+(?:\\.\\d+)?)\\s*h', 1) AS h, regexp_extract(text, '(\\d+)\\s*m', 1) AS m FROM rg),
v AS (SELECT stream, frame, idx, try_cast(nullif(regexp_replace(sum, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS value, CASE left(sum, 1) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' END AS code, CASE WHEN p <> '' THEN try_cast(p AS INT) WHEN a <> '' AND try_cast(b AS INT) > 0 THEN floor(a::DOUBLE * 100 / b::DOUBLE)::INT END AS percent,
 CASE WHEN regexp_matches(text, '^\\s*\\d+:\\d{{2}}\\s*$') THEN regexp_extract(text, '^\\s*(\\d+):', 1)::DOUBLE * 60 + regexp_extract(text, ':(\\d{{2}})', 1)::DOUBLE WHEN h <> '' OR m <> '' THEN coalesce(nullif(h, '')::DOUBLE * 60, 0) + coalesce(nullif(m, '')::DOUBLE, 0) END AS minutes FROM f) SELECT stream, frame, idx, value, code, percent, minutes FROM v WHERE code IS NOT NULL OR percent IS NOT NULL OR minutes IS NOT NULL""")
def x22(spark, d):
    return parsers.amounts(A.regions(spark, d)).select("stream", "frame", "idx", "money.value", "money.code", "percent", "minutes")


FORMS = f"""{PLAIN}, g AS (SELECT *, coalesce((y - lag(y + h) OVER w >= 50)::INT, 0) AS fresh FROM re WINDOW w AS (PARTITION BY stream, frame ORDER BY y, idx)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY stream, frame ORDER BY y, idx) AS form FROM g)"""
FORM_TYPE = " ".join(f"WHEN bool_or({parsers.any_of(*w)}) THEN '{k}'" for w, k in ((("login", "password"), "login_form"), (("contact", "email"), "contact_form"), (("payment", "card"), "payment_form"), (("search",), "search_form")))


@query("x22_form_groups", f"WITH {FORMS} SELECT stream, frame, form::BIGINT AS form, count(*) // 2 AS fields, CASE {FORM_TYPE} ELSE 'general_form' END AS form_type, min(confidence) AS confidence FROM n GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def x22_forms(spark, d):
    return parsers.form_groups(A.regions(spark, d))


STEP_TYPE = " ".join(f"WHEN bool_or(contains(low, '{w}')) THEN '{k}'" for w, k in (("approve", "approval_workflow"), ("review", "review_workflow"), ("test", "testing_workflow"), ("deploy", "deployment_workflow")))


@query("x22_workflow_steps", f"""WITH {PLAIN}, s AS (SELECT *, (regexp_matches(t, '^[0-9]+[.]') OR regexp_matches(t, '^Step [0-9]+') OR contains(low, 'then') OR contains(low, 'next')) AS step FROM re), n AS (SELECT *, sum((NOT step)::INT) OVER (PARTITION BY stream, frame ORDER BY y, idx) AS run FROM s)
SELECT stream, frame, run::BIGINT AS run, count(*) AS steps, CASE {STEP_TYPE} ELSE 'general_workflow' END AS pattern_type, min(confidence) AS confidence FROM n WHERE step GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def x22_steps(spark, d):
    return parsers.step_runs(A.regions(spark, d))


@query("x23_application_family", f"WITH {EV} SELECT event_id, CASE WHEN app_name = 'Slack' THEN 'slack' WHEN app_name = 'Safari' THEN 'web' ELSE 'base' END AS family FROM ev")
def x23(spark, d):
    return A.events(spark, d).select("event_id", parsers.family(F.col("app_name")).alias("family"))


#: Terminals in which people move about.
MOVES = ("../build", "src", "/var/log", "-", "", "~/a/../b")
SHELL = f"""WITH RECURSIVE {A.TERMINAL_SQL}, mv AS (SELECT * REPLACE (CASE WHEN starts_with(text, 'cd ') THEN trim('cd ' || {"[" + ", ".join(f"'{m}'" for m in MOVES) + "]"}[(idx % {len(MOVES)} + 1)::INT]) ELSE text END AS text) FROM tm), {A.read_sql('mv')},
ln AS (SELECT stream, frame, idx, CASE WHEN {_sql(parsers.COMMAND_LINE)} THEN cmd END AS command, coalesce(CASE WHEN said[1] = 'sudo' THEN said[3] ELSE said[2] END, '') AS goal, {_sql(parsers.TERMINAL_ERROR)} AS error, {parsers.any_of('logout', 'exit', 'connection closed', 'session ended', 'terminal session closed')} AS ends FROM re),
se AS (SELECT *, 1 + coalesce(sum(ends::INT) OVER (PARTITION BY stream ORDER BY frame, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS session FROM ln), nu AS (SELECT *, (count(command) OVER (PARTITION BY stream, session ORDER BY frame, idx))::INT AS number FROM se),
ou AS (SELECT stream, session, number, (count(*) FILTER (command IS NULL))::INT AS n_output, coalesce(bool_or(error) FILTER (command IS NULL), false) AS failed FROM nu WHERE number > 0 GROUP BY 1, 2, 3),
wa AS (SELECT stream, session, 1 AS number, '~' AS root, []::VARCHAR[] AS parts, '~' AS proot, []::VARCHAR[] AS pparts FROM nu WHERE number = 1 AND command IS NOT NULL
 UNION ALL SELECT w.stream, w.session, w.number + 1, CASE WHEN NOT cd THEN root WHEN goal IN ('', '~') THEN '~' WHEN goal = '-' THEN proot WHEN starts_with(goal, '/') THEN '/' WHEN starts_with(goal, '~/') THEN '~' ELSE root END,
 CASE WHEN NOT cd THEN parts WHEN goal IN ('', '~') THEN [] WHEN goal = '-' THEN pparts WHEN goal = '/var/log' THEN ['var', 'log'] WHEN goal = '~/a/../b' THEN ['b'] WHEN goal = 'src' THEN list_append(parts, 'src') WHEN goal = '../build' THEN list_append(parts[:len(parts) - 1], 'build') END, CASE WHEN cd THEN root ELSE proot END, CASE WHEN cd THEN parts ELSE pparts END
 FROM wa w JOIN (SELECT stream, session, number, command = 'cd' AS cd, goal FROM nu WHERE command IS NOT NULL) n ON n.stream = w.stream AND n.session = w.session AND n.number = w.number JOIN (SELECT stream, session, max(number) AS last FROM nu GROUP BY 1, 2) m ON m.stream = w.stream AND m.session = w.session AND w.number < m.last),
ex AS (SELECT nu.stream, nu.session, nu.number, frame, idx, command, CASE WHEN len(parts) = 0 THEN root ELSE rtrim(root, '/') || '/' || array_to_string(parts, '/') END AS directory, n_output, failed FROM nu JOIN wa USING (stream, session, number) JOIN ou USING (stream, session, number) WHERE command IS NOT NULL)"""


def shell(spark, d):
    t = A.terminal(spark, d)
    to = F.element_at(F.array(*map(F.lit, MOVES)), (F.col("idx") % len(MOVES) + 1).cast("int"))
    return t.withColumn("text", F.when(F.startswith("text", F.lit("cd ")), F.trim(F.concat(F.lit("cd "), to))).otherwise(F.col("text")))


@query("m16_executions", f"{SHELL} SELECT * FROM ex")
def m16_executions(spark, d):
    return terminals.executions(shell(spark, d))


@query("m16_session_metrics", f"""{SHELL} SELECT stream, session, min(frame) AS start, max(frame) AS "end", count(*) AS commands, round(avg((command IN {_names(parsers.PRODUCTIVE)})::INT), 6) AS productivity, round(avg(failed::INT), 6) AS error_rate, arg_max(directory, number) AS directory, sum(n_output)::BIGINT AS n_output,
 round(CASE WHEN max(frame) > min(frame) THEN count(*) / ((max(frame) - min(frame)) / 60) END, 6) AS per_minute FROM ex GROUP BY 1, 2""")
def m16_metrics(spark, d):
    return terminals.sessions(terminals.executions(shell(spark, d)))


@query("x9_repeated_sequences", f"""{SHELL}, sq AS (SELECT stream, [command, lead(command) OVER (PARTITION BY stream, session ORDER BY number)] AS sequence FROM ex) SELECT stream, sequence, count(*) AS n FROM sq WHERE sequence[2] IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def x9_repeated(spark, d):
    return terminals.repeated_sequences(terminals.executions(shell(spark, d)))
