"""Application parsers: rule tables that turn text regions into structured rows.

A rule is a family, a semantic type, a test and named attributes, all SQL expressions over a region: t (its trimmed text), low
(t in lower case), cmd (its first word, a prompt sign and sudo left out), y. A region is tested by the rules of its own
application's family only, and those for all; the numbers of the rules it meets become an array, exploded, so a pass over the
regions needs no shuffle. Most tests are plain searches for words, which are far cheaper than patterns. Adding a row to RULES adds an element.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def any_of(*words: str) -> str:
    """The text holds one of the words, in any case."""
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def has(*parts: str) -> str:
    """The text holds one of the parts as written."""
    return "(" + " OR ".join(f"contains(t, '{p}')" for p in parts) + ")"


def starts(*parts: str) -> str:
    return "(" + " OR ".join(f"left(t, {len(p)}) = '{p}'" for p in parts) + ")"


def like(pattern: str) -> str:
    """The text holds a match of the pattern."""
    return f"regexp_like(t, '{pattern}')"


def pick(*groups: tuple[str, str], otherwise: str = "") -> str:
    """The value of the first test that holds."""
    return "CASE " + " ".join(f"WHEN {test} THEN '{value}'" for test, value in groups) + f" ELSE '{otherwise}' END"


def words(*groups: tuple[str, str], otherwise: str = "") -> str:
    """The value of the first group, of words parted by |, of which the text holds one."""
    return pick(*((any_of(*g.split("|")), value) for g, value in groups), otherwise=otherwise)


def flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 'true' ELSE 'false' END"


@dataclass(frozen=True)
class Rule:
    family: str
    kind: str
    test: str
    attributes: dict[str, str] = field(default_factory=dict)


# Word lists, patterns, classes and their order.
COMMANDS = "ls|cd|pwd|mkdir|rm|cp|mv|cat|grep|find|ps|top|kill|chmod|chown|sudo|git|npm|pip|docker|kubectl|ssh|scp|rsync|tar|zip|unzip"
COMMAND_KINDS = (
    ("ls ll la dir", "file_listing"), ("cd pushd popd", "navigation"), ("mkdir rmdir rm cp mv", "file_management"), ("cat less more head tail", "file_viewing"), ("grep find locate which", "search"),
    ("ps top htop kill killall", "process_management"), ("chmod chown chgrp", "permissions"), ("git", "version_control"), ("npm pip brew apt yum", "package_management"), ("docker kubectl", "containerization"), ("ssh scp rsync", "network"), ("tar zip unzip gzip", "compression"),
)
PRODUCTIVE = ("git", "npm", "yarn", "make", "cargo", "mvn", "gradle", "docker", "kubectl")
BUILDS = ("make", "npm", "yarn", "cargo", "mvn", "gradle", "xcodebuild")
FILE_COMMANDS = ("ls", "cd", "mkdir", "cp", "mv", "rm")
EXPLORING = ("ls", "cd", "find", "grep")
STAGES = (("closed won", "won"), ("closed lost", "lost"), ("proposal|negotiation", "late_stage"))
PROBABILITIES = (("prospecting", "10"), ("qualification", "25"), ("needs analysis", "50"), ("proposal", "75"), ("negotiation", "90"), ("closed won", "100"), ("closed lost", "0"))
PIPELINE = (("prospecting", "early_stage"), ("qualification", "early_stage"), ("needs analysis", "mid_stage"), ("proposal", "late_stage"), ("negotiation", "late_stage"), ("closed won", "won"), ("closed lost", "lost"))
TRANSITIONS = (("start|begin", "start"), ("stop|pause", "pause"), ("done|complete", "complete"), ("resolve", "resolve"))
TRANSITION_STAGES = (("start|begin", "active"), ("stop|pause", "blocked"), ("done|complete", "complete"), ("resolve", "complete"))
COLUMNS = (("backlog", "backlog"), ("to do|todo", "todo"), ("progress", "in_progress"), ("review", "review"), ("test", "testing"), ("done", "done"))
COLUMN_STAGES = (("backlog", "planning"), ("to do|todo", "ready"), ("progress", "active"), ("review", "validation"), ("test", "validation"), ("done", "complete"))
PRIORITY = (("critical|p1", "critical"), ("high|urgent|p2", "high"), ("medium|normal|p3", "medium"), ("low|p4", "low"))
PRIORITY_VALUES = (("critical|p1", "4"), ("high|urgent|p2", "3"), ("medium|normal|p3", "2"), ("low|p4", "1"))
BUTTONS = ("OK", "Cancel", "Submit", "Save", "Delete", "Edit", "Add", "Remove", "Next", "Previous", "Continue", "Finish")
LISTING = "(" + like("^[drwx-]{10} +[0-9]+") + " OR " + like("^[0-9]+ +[A-Za-z]{3} +[0-9]+") + ")"
PROCESSES = "(" + like("^ *[0-9]+ +") + " AND " + has("TTY", "%CPU", "CMD") + ")"
TERMINAL_ERROR = has("error", "Error", "ERROR", "failed", "Failed", "FAILED", "cannot", "Cannot", "CANNOT", "not found", "Not found", "permission denied", "Permission denied")
COMMAND_LINE = "(" + starts("$ ", "% ", "# ") + " OR " + like(f"^({COMMANDS})( |$)") + ")"
DATA = "(" + has(":", "=") + " OR " + like("[0-9]+ +[0-9]+") + ")"
FORM_LABEL = "(" + any_of("name", "email", "password", "address", "phone", "username") + " OR right(t, 1) = ':' OR right(t, 1) = '*')"
FORM_BUTTON = any_of("submit", "send", "save", "continue", "next", "previous", "cancel", "reset")
LINK = "(" + any_of("click here", "learn more", "read more", "view details", "download", "sign up", "log in", "register") + " OR " + starts("http") + " OR " + has("www.") + ")"
OUTSIDE = "(" + starts("http") + " OR " + has("www.") + ")"
HEADING = f"""CASE WHEN length(t) < 3 OR length(t) > 100 OR {FORM_LABEL} OR {FORM_BUTTON} THEN NULL WHEN y < 150 AND length(t) < 50 THEN 1 WHEN y < 300 AND length(t) < 80 THEN 2
 WHEN length(t) < 60 THEN least(6, greatest(3, CAST(floor(y / 100) AS INT) + 1)) END"""
PAGE = like("[0-9]+")
SECTION = "(" + like("^[0-9]+([.][0-9]+)* +") + " OR (length(t) < 100 AND length(t) > 5 AND NOT contains(t, '.')))"
#: A label of a field: what ends in a colon, or is short.
UI_LABEL = "(right(t, 1) = ':' OR length(t) < 50)"
ELEMENT = pick(
    (FORM_BUTTON, "button"), (LINK, "link"), (any_of("dropdown", "select"), "dropdown"), (any_of("tab") + " AND length(t) < 20", "tab"), (any_of("checkbox") + " OR t IN ('☐', '☑')", "checkbox"), (any_of("radio") + " OR t IN ('○', '●')", "radio"),
)
ASSIGNMENTS = (("assignee|assigned", "assignee"), ("owner", "owner"), ("reporter", "reporter"), ("responsible", "responsible"))
ASSIGNED = any_of("assignee", "owner", "reporter", "responsible", "assigned to")
RECORD_FIELD = any_of("account name", "contact name", "opportunity name", "amount", "close date", "stage", "lead source", "owner")
RECORD_TYPES = (("date", "date"), ("amount|value", "currency"), ("name", "text"), ("stage|status", "picklist"))

RULES = (
    Rule("base", "button", "(t IN (" + ", ".join(f"'{b}'" for b in BUTTONS) + ") OR (length(t) <= 20 AND NOT contains(t, ' ') AND upper(t) = t))"),
    Rule("terminal", "command_line", COMMAND_LINE, {"command": "cmd", "command_type": pick(*((f"cmd IN ({', '.join(repr(c) for c in names.split())})", kind) for names, kind in COMMAND_KINDS), otherwise="other"), "is_sudo": flag(like("^([$%#] )?sudo( |$)"))}),
    Rule("terminal", "command_option", "(left(t, 1) = '-' AND length(t) > 1)", {"option_type": pick((starts("--"), "long_option"), otherwise="short_option"), "is_long_form": flag(starts("--"))}),
    Rule("terminal", "command_output", f"NOT {COMMAND_LINE}", {"output_type": pick((LISTING, "file_listing"), (PROCESSES, "process_listing"), (TERMINAL_ERROR, "error"), (DATA, "structured_data"), otherwise="text"), "contains_data": flag(DATA)}),
    Rule("terminal", "file_listing", LISTING, {"permissions": "CASE WHEN " + like("^[drwx-]{10}") + " THEN split_part(t, ' ', 1) ELSE '' END", "is_directory": flag("left(t, 1) = 'd'")}),
    Rule("terminal", "process_listing", PROCESSES, {"pid": "split_part(t, ' ', 1)"}),
    Rule("terminal", "shell_prompt", "(" + like("[a-zA-Z0-9_-]+@[a-zA-Z0-9_-]+:") + " OR " + like("[a-zA-Z0-9_-]+ *[$%#] *$") + ")", {
        "username": "CASE WHEN contains(t, '@') THEN split_part(t, '@', 1) ELSE '' END", "hostname": "CASE WHEN contains(t, '@') THEN split_part(split_part(t, '@', 2), ':', 1) ELSE '' END",
        "current_directory": "CASE WHEN contains(t, '@') THEN trim(regexp_replace(split_part(split_part(t, '@', 2), ':', 2), '[ $%#]+$', '')) ELSE '' END", "shell_type": pick(("NOT contains(t, '@')", "unknown"), ("contains(t, '$')", "bash"), otherwise="zsh"), "is_root": flag("contains(t, '#')"),
    }),
    Rule("terminal", "error_message", TERMINAL_ERROR, {
        "error_type": words(("permission denied", "permission_error"), ("not found|no such file", "file_not_found"), ("command not found", "command_not_found"), ("syntax error", "syntax_error"), ("connection", "network_error"), otherwise="general_error"),
        "severity": words(("fatal|critical", "critical"), ("error", "error"), ("warning", "warning"), otherwise="info"),
    }),
    Rule("terminal", "warning_message", has("warning", "Warning", "WARNING", "caution", "Caution"), {"warning_type": words(("deprecated", "deprecation_warning"), ("security", "security_warning"), ("performance", "performance_warning"), otherwise="general_warning")}),
    Rule("terminal", "file_path", "(" + starts("/", "./", "../", "~") + " OR " + like("[a-zA-Z0-9_-]+/[a-zA-Z0-9_.-]+") + ")", {
        "path_type": pick((starts("/"), "absolute"), (starts("./"), "relative_current"), (starts("../"), "relative_parent"), (starts("~"), "home_relative"), otherwise="relative"), "is_absolute": flag(starts("/")),
        "file_extension": "regexp_extract(t, '[.]([^. ]{0,10})$', 1)", "directory_depth": "CAST(length(t) - length(replace(t, '/', '')) AS STRING)",
    }),
    Rule("terminal", "session_start", has("login:", "Welcome to", "Last login:", "Terminal session started", "New session", "Connected to"), {"session_type": pick((has("ssh", "Connected to"), "remote_ssh"), (has("docker"), "container"), (has("sudo"), "elevated"), otherwise="local")}),
    Rule("terminal", "session_end", any_of("logout", "exit", "connection closed", "session ended", "terminal session closed")),
    Rule("terminal", "file_operation", starts("cp ", "mv ", "rm ", "mkdir ", "rmdir ", "ln ", "chmod ", "chown "), {"source": "split_part(t, ' ', 2)", "target": "split_part(t, ' ', 3)"}),
    Rule("terminal", "system_info", "(" + has("CPU:", "Memory:", "Disk:") + " OR " + like("[0-9]+%") + " OR " + like("[0-9]+ *(GB|MB|KB)") + ")", {
        "metric": words(("cpu", "cpu"), ("memory|mem", "memory"), ("disk", "disk"), otherwise="unknown"),
        "value": "CASE WHEN contains(low, 'cpu') THEN regexp_extract(t, '[0-9]+([.][0-9]+)?%', 0) WHEN contains(low, 'mem') THEN regexp_extract(t, '[0-9]+([.][0-9]+)? *(GB|MB|KB)', 0) WHEN contains(low, 'disk') THEN regexp_extract(t, '[0-9]+([.][0-9]+)? *(GB|MB|TB)', 0) ELSE t END",
    }),
    Rule("web", "link", LINK, {"link_type": pick((OUTSIDE, "external"), (any_of("download"), "download"), (any_of("sign up", "register"), "registration"), (any_of("log in", "login"), "authentication"), otherwise="navigation"), "is_external": flag(OUTSIDE)}),
    Rule("web", "breadcrumb", has(">", "/", "›"), {"level": "CAST(1 + CASE WHEN contains(t, '>') THEN length(t) - length(replace(t, '>', '')) WHEN contains(t, '/') THEN length(t) - length(replace(t, '/', '')) ELSE length(t) - length(replace(t, '›', '')) END AS STRING)"}),
    Rule("web", "heading", f"({HEADING}) IS NOT NULL", {"heading_level": f"CAST({HEADING} AS STRING)", "is_page_title": flag(f"({HEADING}) = 1")}),
    Rule("web", "form_field", FORM_LABEL, {"field_type": words(("email", "email"), ("password", "password"), ("phone|tel", "tel"), ("date", "date"), ("number|amount", "number"), otherwise="text"), "required": flag("contains(t, '*') OR contains(low, 'required')")}),
    Rule("web", "form_button", FORM_BUTTON, {"button_type": words(("submit|send", "submit"), ("cancel|close", "cancel"), ("next|continue", "navigation"), ("save", "save"), otherwise="action"), "is_primary": flag(any_of("submit", "send", "save", "continue", "next", "sign up", "log in"))}),
    Rule("web", "validation_message", any_of("error", "invalid", "required", "must", "cannot", "please"), {
        "message_type": words(("error|invalid", "error"), ("required|must", "required"), ("success|saved", "success"), otherwise="info"), "severity": words(("error|failed", "error"), ("warning|caution", "warning"), ("success", "success"), otherwise="info"),
    }),
    Rule("web", "navigation_item", "(" + any_of("home", "about", "contact", "products", "services", "blog", "news") + " OR (length(t) < 20 AND NOT contains(t, ' ')))", {"nav_level": pick(("y < 100", "1"), ("y < 200", "2"), otherwise="3")}),
    Rule("web", "pagination", "(" + PAGE + " OR " + any_of("next", "prev") + " OR t IN ('...', '«', '»'))", {"pagination_type": pick((PAGE, "page_number"), (any_of("next"), "next"), (any_of("prev"), "previous"), otherwise="navigation"), "page_number": "CASE WHEN " + like("^[0-9]+$") + " THEN t ELSE '' END"}),
    Rule("web", "interactive_element", f"({ELEMENT}) <> ''", {"element_type": ELEMENT, "element_state": pick((any_of("active", "selected"), "active"), (any_of("disabled"), "disabled"), ("t IN ('☑', '●')", "checked"), ("t IN ('☐', '○')", "unchecked"))}),
    Rule("jira", "issue_key", like("[A-Z]+-[0-9]+"), {"project": "split_part(t, '-', 1)", "issue_number": "regexp_extract(t, '-([0-9]+)$', 1)"}),
    Rule("jira", "issue_type", any_of("story", "bug", "task", "epic", "subtask", "improvement"), {"type_category": words(("bug", "defect"), ("story", "feature"), ("epic", "epic"), ("task", "task"), otherwise="other")}),
    Rule("jira", "sprint", any_of("sprint"), {"sprint_state": words(("active", "active"), ("closed", "closed"), ("future", "future"), otherwise="unknown")}),
    Rule("jira", "story_points", like("^[0-9]+([.][0-9]+)? *(pts?|points?)?$"), {"points": "regexp_extract(t, '^[0-9]+', 0)"}),
    Rule("jira", "transition", any_of("start progress", "stop progress", "done", "resolve", "close", "reopen", "in review"), {"transition_type": words(*TRANSITIONS, otherwise="transition"), "workflow_stage": words(*TRANSITION_STAGES, otherwise="intermediate")}),
    Rule("jira", "board_column", any_of("to do", "in progress", "code review", "testing", "done", "backlog"), {"column_type": words(*COLUMNS, otherwise="other"), "workflow_stage": words(*COLUMN_STAGES, otherwise="intermediate")}),
    Rule("jira", "epic_link", "(" + like("Epic: *[A-Z]+-[0-9]+") + " OR " + any_of("epic link") + ")", {"epic_key": "regexp_extract(t, '[A-Z]+-[0-9]+', 0)"}),
    Rule("jira", "component", "(" + any_of("component") + " AND length(t) < 100)", {"component_category": words(("frontend|ui", "frontend"), ("backend|api", "backend"), ("database|db", "database"), otherwise="general")}),
    Rule("salesforce", "record_id", like("[a-zA-Z0-9]{15,18}"), {"object_type": pick(("left(t, 3) = '001'", "Account"), ("left(t, 3) = '003'", "Contact"), ("left(t, 3) = '006'", "Opportunity"), ("left(t, 3) = '00Q'", "Lead"), ("left(t, 3) = '500'", "Case"), otherwise="Unknown")}),
    Rule("salesforce", "opportunity_stage", any_of("prospecting", "qualification", "needs analysis", "value proposition", "proposal", "negotiation", "closed won", "closed lost"), {"stage_category": words(*STAGES, otherwise="early_stage")}),
    Rule("salesforce", "lead_status", any_of("new", "working", "nurturing", "qualified", "unqualified"), {"status_category": words(("qualified", "qualified"), ("working|nurturing", "in_progress"), otherwise="new")}),
    Rule("salesforce", "currency", like("[$€£¥] *[0-9,]+([.][0-9]{2})?"), {"amount": "replace(regexp_extract(t, '[$€£¥] *([0-9,]+([.][0-9]+)?)', 1), ',', '')", "currency": pick((has("$"), "USD"), (has("€"), "EUR"), (has("£"), "GBP"), (has("¥"), "JPY"), otherwise="USD")}),
    Rule("salesforce", "workflow_rule", any_of("workflow rule", "process builder"), {"rule_type": words(("field update", "field_update"), ("email alert", "email_alert"), ("task", "task_creation"), otherwise="general"), "is_active": flag("contains(low, 'active') AND NOT contains(low, 'inactive')")}),
    Rule("salesforce", "approval_process", any_of("approval", "approved", "rejected"), {"approval_stage": words(("pending", "pending"), ("approved", "approved"), ("rejected", "rejected"), ("recalled", "recalled"), otherwise="unknown")}),
    Rule("salesforce", "pipeline_stage", any_of("prospecting", "qualification", "needs analysis", "proposal", "negotiation", "closed won", "closed lost"), {"stage_probability": words(*PROBABILITIES, otherwise="50"), "stage_category": words(*PIPELINE, otherwise="mid_stage")}),
    Rule("salesforce", "territory", any_of("territory", "region"), {"territory_type": words(("north|south|east|west", "geographic"), ("enterprise|smb", "segment"), otherwise="general")}),
    Rule("office", "document_section", SECTION, {"section_level": pick((like("^[0-9]+ +"), "1"), (like("^[0-9]+[.][0-9]+ +"), "2"), (like("^[0-9]+[.][0-9]+[.][0-9]+ +"), "3"), ("y < 100", "1"), ("y < 200", "2"), otherwise="3")}),
    Rule("office", "table_header", "(length(t) < 50 AND y < 300)", {"column_type": words(("date|time", "date"), ("amount|price|cost", "currency"), ("count|number|qty", "number"), otherwise="text")}),
    Rule("slack", "channel", "(" + starts("#") + " OR " + any_of("channel") + ")", {"channel_type": words(("general", "general"), ("random", "social"), ("dev|engineering", "development"), ("marketing", "marketing"), ("support", "support"), otherwise="topic"), "is_private": flag("contains(t, '🔒') OR contains(low, 'private')")}),
    Rule("slack", "mention", has("@"), {"mention_type": pick((has("@channel", "@here"), "channel_mention"), (has("@everyone"), "everyone_mention"), otherwise="user_mention"), "username": "regexp_extract(t, '@([A-Za-z0-9_]+)', 1)"}),
    Rule("slack", "thread", "(" + like("[0-9]+ +repl(y|ies)") + " OR " + any_of("thread") + ")", {"thread_count": "CASE WHEN " + PAGE + " THEN regexp_extract(t, '[0-9]+', 0) ELSE '0' END"}),
    Rule("notion", "property", any_of("status", "assignee", "due date", "priority", "tags", "created", "last edited"), {"property_type": words(("date", "date"), ("status", "select"), ("assignee|person", "person"), ("tag", "multi_select"), ("number|count", "number"), otherwise="text")}),
    Rule("notion", "page_hierarchy", "(" + like("^ *[▶▼] +") + " OR " + has("└", "├") + ")"),
    Rule("notion", "block", starts("# ", "## ", "- ", "1. "), {"block_type": pick((starts("# "), "heading_1"), (starts("## "), "heading_2"), (starts("- "), "bulleted_list"), (like("^[0-9]+[.] "), "numbered_list"), otherwise="paragraph")}),
    Rule("asana", "section", "(" + any_of("section") + " OR (length(t) < 50 AND upper(t) = t AND NOT contains(t, ' ')))", {"section_type": words(("todo|to do", "todo"), ("progress|doing", "in_progress"), ("done|complete", "complete"), ("review", "review"), otherwise="custom")}),
    Rule("asana", "dependency", any_of("depends on", "blocked by", "waiting for"), {"dependency_type": words(("blocked", "blocking"), ("waiting", "waiting"), ("depends", "dependency"), otherwise="related")}),
    Rule("asana", "custom_field", f"(contains(t, ':') AND length(t) < 100 AND NOT {UI_LABEL})", {"field_type": words(("date", "date"), ("priority", "enum"), ("effort|points", "number"), otherwise="text")}),
    Rule("common", "workflow_state", any_of("to do", "in progress", "done", "blocked", "review", "testing", "approved", "rejected"), {
        "state_category": words(("to do|new", "initial"), ("progress|working", "active"), ("done|complete", "complete"), ("blocked|waiting", "blocked"), otherwise="intermediate"), "is_terminal": flag(any_of("done", "complete", "closed", "resolved", "cancelled", "rejected")),
    }),
    Rule("common", "action_button", any_of("create", "edit", "delete", "save", "cancel", "submit", "approve", "reject", "assign"), {
        "action_type": words(("create|add", "create"), ("edit|update", "update"), ("delete|remove", "delete"), ("save|submit", "save"), otherwise="action"), "is_destructive": flag(any_of("delete", "remove", "cancel", "reject")),
    }),
    Rule("common", "status_indicator", any_of("active", "inactive", "pending", "complete", "failed", "success", "warning", "error"), {
        "status_type": words(("success|complete", "success"), ("error|failed", "error"), ("warning|pending", "warning"), otherwise="info"), "severity": words(("error|failed", "high"), ("warning", "medium"), otherwise="low"),
    }),
    Rule("common", "priority_indicator", any_of("high", "medium", "low", "critical", "urgent", "normal", "p1", "p2", "p3", "p4"), {"priority_level": words(*PRIORITY, otherwise="medium"), "priority_value": words(*PRIORITY_VALUES, otherwise="2")}),
    Rule("common", "form_validation", "(" + any_of("required", "invalid", "error", "must", "cannot", "please") + " AND length(t) < 200)", {
        "validation_type": words(("required", "required"), ("format|invalid", "format"), ("length|character", "length"), ("match|confirm", "match"), otherwise="general"), "is_error": flag(any_of("error", "invalid", "incorrect", "failed")),
    }),
    Rule("common", "required_field", "(contains(t, '*') OR contains(low, 'required'))"),
    Rule("common", "dropdown_option", "(" + has("▼", "⌄") + " OR (length(t) < 50 AND NOT contains(t, ':')))", {"option_category": words(("select", "placeholder"), ("all|any", "filter"), otherwise="option")}),
    Rule("common", "progress_percentage", "(" + like("[0-9]+%") + " OR " + like("[0-9]+/[0-9]+") + ")", {"progress_type": pick((any_of("complete"), "completion"), (any_of("progress"), "progress"), (has("/"), "fraction"), otherwise="percentage")}),
    Rule("common", "milestone", "(" + any_of("milestone") + " OR " + has("🏁", "📍") + ")", {"milestone_type": words(("release", "release"), ("sprint", "sprint"), ("phase", "phase"), otherwise="general"), "is_completed": flag("contains(t, '✓') OR contains(t, '✅') OR contains(low, 'completed')")}),
    Rule("common", "deadline", any_of("due", "deadline", "expires"), {"deadline_urgency": words(("overdue|late", "overdue"), ("today|urgent", "urgent"), ("tomorrow|soon", "high"), otherwise="normal"), "is_overdue": flag("contains(low, 'overdue') OR contains(low, 'late') OR contains(t, '🔴')")}),
    Rule("common", "task", "(length(t) > 10 AND length(t) < 200 AND right(t, 1) <> ':')", {"task_type": words(("bug|fix", "bug"), ("feature|implement", "feature"), ("test|verify", "test"), ("document|write", "documentation"), otherwise="task")}),
    Rule("common", "time_tracking", "(" + like("[0-9]+[hm]") + " OR " + like("[0-9]+:[0-9]+") + " OR " + like("[0-9]+[.][0-9]+h") + ")", {"time_type": words(("logged", "logged"), ("remaining", "remaining"), ("estimate", "estimate"), otherwise="duration")}),
)
#: Which family an application's bundle or window title speaks for, the first that matches.
APPS = (("terminal|iterm", "terminal"), ("jira|atlassian", "jira"), ("salesforce|force.com", "salesforce"), ("word|excel|powerpoint|office", "office"), ("slack", "slack"), ("notion", "notion"), ("asana", "asana"), ("safari|chrome|firefox|http", "web"))
#: Families whose regions the common rules see too.
PRODUCTIVITY = ("jira", "salesforce", "office", "slack", "notion", "asana")
#: Page types by parts of the url, and web applications by domain.
PAGE_TYPES = (("/login|/signin", "login"), (r"/search|\?q=", "search_results"), ("/profile|/account", "user_profile"), ("/dashboard", "dashboard"), ("/checkout|/cart", "checkout"), ("/product/|/item/", "product_page"), ("/error|/404", "error"))
#: Of web applications their kind, what in the domain or the url tells of it, and what the detail is named by.
WEB_APPS = (
    ("ecommerce", ("shop", "store"), ("/product", "/cart"), (("electronics", "electronics"), ("clothing", "clothing"), ("books", "books"), ("home", "home"), ("sports", "sports"), ("beauty", "beauty")), "url"),
    ("social_media", ("facebook.com", "twitter.com", "linkedin.com", "instagram.com"), (), (("facebook", "Facebook"), ("twitter", "Twitter"), ("linkedin", "LinkedIn"), ("instagram", "Instagram")), "host"),
    ("productivity", ("jira", "confluence", "trello", "asana", "notion"), (), (("jira", "Jira"), ("confluence", "Confluence"), ("trello", "Trello"), ("asana", "Asana"), ("notion", "Notion")), "host"),
    ("crm", ("salesforce", "hubspot", "pipedrive"), (), (("salesforce", "Salesforce"), ("hubspot", "HubSpot"), ("pipedrive", "Pipedrive")), "host"),
    ("documentation", ("docs",), ("/docs/",), (("react", "react"), ("vue", "vue"), ("angular", "angular"), ("django", "django"), ("rails", "rails"), ("laravel", "laravel")), "host"),
)
#: What parts a trail of pages, in the order in which they are tried; a text with one of the first three is one.
CRUMBS = (">", "/", "›", "»", "→")


def _first(value: Column, groups) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(groups):
        out = F.when(F.lower(value).rlike(pattern), name).otherwise(out)
    return out


def family(app: Column) -> Column:
    return F.coalesce(_first(app, APPS), F.lit("base"))


def _read(regions: DataFrame, app: str | None) -> DataFrame:
    """regions with what rules read: t, low, cmd, family; those without text are left out."""
    r = regions.withColumn("t", F.trim("text")).where("t != ''")
    first = F.filter(F.split(F.regexp_replace("t", "^[$%#] ", ""), " "), lambda w: w != "")
    own = family(F.col(app)) if app else F.lit("base")
    r = r.withColumns({"low": F.lower("t"), "__words": first, "family": own})
    at = F.when(F.get("__words", F.lit(0)) == "sudo", 1).otherwise(0)
    return r.withColumn("cmd", F.coalesce(F.get("__words", at), F.lit(""))).drop("__words")


def elements(regions: DataFrame, app: str | None = None, families: tuple[str, ...] | None = None) -> DataFrame:
    """A row for every rule that a region meets: stream, frame, idx, family, semantic_type, attributes (name=value in the
    rule's order), text, confidence. app: the column with the region's application; or the families to apply to all."""

    # first which rules are met, by number, then the attributes of those only: the expressions of all at once would be more
    # code than the JVM compiles
    def met(fam: str) -> Column:
        return F.array(*[F.when(F.expr(r.test), F.lit(k)) for k, r in enumerate(RULES) if r.family == fam])

    r = _read(regions, app)
    if families is not None:
        tried = [met(f) for f in families]
    else:
        none = own = F.array().cast("array<int>")
        for fam in ("terminal", "web", *PRODUCTIVITY):
            own = F.when(F.col("family") == fam, met(fam)).otherwise(own)
        tried = [met("base"), own, F.when(F.col("family").isin(*PRODUCTIVITY), met("common")).otherwise(none)]
    e = r.select("stream", "frame", "idx", "t", "low", "cmd", "y", "confidence", F.explode(F.concat(*tried)).alias("rule")).where("rule is not null")
    attributes = F.array().cast("array<string>")
    for k, r in enumerate(RULES):
        if r.attributes:
            attributes = F.when(F.col("rule") == k, F.array(*[F.concat(F.lit(f"{n}="), F.expr(value)) for n, value in r.attributes.items()])).otherwise(attributes)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)
    return e.select("stream", "frame", "idx", of([r.family for r in RULES]).alias("family"), of([r.kind for r in RULES]).alias("semantic_type"), attributes.alias("attributes"), F.col("t").alias("text"), "confidence")


def elements_sql(regions: str, families: tuple[str, ...] | None = None) -> str:
    """The rows of elements(), but text, as SQL over a relation with t, low, cmd, family and the regions' columns: what the
    queries are held against."""
    out = []
    for r in RULES:
        if families is None or r.family in families:
            where = "true" if families is not None or r.family == "base" else f"family IN ({', '.join(map(repr, PRODUCTIVITY))})" if r.family == "common" else f"family = '{r.family}'"
            attributes = ", ".join(f"'{n}=' || {value}" for n, value in r.attributes.items())
            out.append(f"SELECT stream, frame, idx, '{r.family}' AS family, '{r.kind}' AS semantic_type, [{attributes}]::VARCHAR[] AS attributes, confidence FROM {regions} WHERE {where} AND {r.test}")
    return " UNION ALL ".join(out).replace("regexp_like(", "regexp_matches(").replace(" AS STRING)", " AS VARCHAR)")


def fields(pairs: DataFrame) -> DataFrame:
    """Labels with their values, given pairs (stream, frame, idx, text, confidence, and b_ of the value): label, value, the
    lower confidence, and what the label says of them: an assignment, or a typed field of a record (null for neither)."""
    key = ["stream", "frame"]
    j = pairs.select(*key, "idx", "b_idx", F.trim("text").alias("label"), F.trim("b_text").alias("value"), F.col("confidence").alias("a_confidence"), "b_confidence")
    j = j.withColumn("label", F.expr("trim(BOTH ': ' FROM label)")).withColumn("low", F.lower("label"))
    assigned = F.when(F.expr(ASSIGNED), F.expr(words(*ASSIGNMENTS, otherwise="assignment")))
    record = F.when(F.expr(RECORD_FIELD), F.expr(words(*RECORD_TYPES, otherwise="text")))
    return j.select(*key, "idx", "b_idx", "label", "value", F.least("a_confidence", "b_confidence").alias("confidence"), assigned.alias("assignment"), record.alias("record_type"))


def base_events(delta: DataFrame, regions: DataFrame) -> DataFrame:
    """Events of changed and added regions that aren't labels: field_change, content_added; with category and importance."""
    d = delta.where(F.col("change").isin("modified", "added")).join(regions, ["stream", "seq", "idx"])
    d = d.where((F.trim("text") != "") & ~F.trim("text").endswith(":"))
    changed = F.col("change") == "modified"
    return d.select(
        "stream", "frame", "idx", F.when(changed, "field_change").otherwise("content_added").alias("type"), F.format_string("field_%d_%d", F.col("x").cast("int"), F.col("y").cast("int")).alias("target"), F.trim("text").alias("value"), "confidence",
        F.when(changed, "data_modification").otherwise("data_creation").alias("category"), F.when(changed, "medium").otherwise("low").alias("importance"),
    )


def commands(regions: DataFrame) -> DataFrame:
    """Command lines taken apart: command, its kind, sudo, arguments."""
    c = elements(regions, families=("terminal",)).where("semantic_type = 'command_line'")
    said = F.filter(F.split(F.regexp_replace("text", "^[$%#] ", ""), " "), lambda w: w != "")
    c = c.withColumn("words", said).withColumn("sudo", F.coalesce(F.get("words", F.lit(0)) == "sudo", F.lit(False)))
    at = F.when(F.col("sudo"), 1).otherwise(0)
    c = c.withColumn("command", F.coalesce(F.get("words", at), F.lit(""))).withColumn("arguments", F.slice("words", at + 2, F.greatest(F.size("words"), F.lit(1))))
    kinds = F.create_map(*[F.lit(x) for names, kind in COMMAND_KINDS for n in names.split() for x in (n, kind)])
    return c.withColumn("kind", F.coalesce(kinds[F.col("command")], F.lit("other"))).drop("words", "family", "semantic_type", "attributes")


def _holds(value: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(value, F.lit(n))
    return out


def pages(visits: DataFrame) -> DataFrame:
    """Type, application (its kind, and what it is in detail), and single-page route of each page visited.

    visits: url, host, and if known has_form and content, the page's text (else its title). Parts of the url decide first,
    then a form, a route, and words of the content.
    """
    url, host = F.lower("url"), F.lower("host")
    content = F.lower("content") if "content" in visits.columns else F.lower("title")
    form = F.coalesce(F.col("has_form"), F.lit(False)) if "has_form" in visits.columns else F.lit(False)
    hash_at = F.when(F.contains("url", F.lit("#/")), F.lit("#/")).when(F.contains("url", F.lit("#!/")), F.lit("#!/"))
    route = F.when(hash_at.isNotNull(), F.expr("substring(url, locate(mark, url) + length(mark))"))
    kind = F.coalesce(_first(url, PAGE_TYPES), F.when(form, "form"), F.when(F.col("mark").isNotNull(), "spa"), F.when(_holds(content, ("article", "blog")), "article"), F.when(_holds(content, ("list", "catalog")), "listing"), F.lit("homepage"))
    app = detail = F.lit(None).cast("string")
    for name, domains, parts, details, where in reversed(WEB_APPS):
        met = _holds(host, domains) | _holds(url, parts)
        named = F.lit(None).cast("string")
        for part, said in reversed(details):
            named = F.when(F.contains(url if where == "url" else host, F.lit(part)), said).otherwise(named)
        app, detail = F.when(met, name).otherwise(app), F.when(met, named).otherwise(detail)
    v = visits.withColumn("mark", hash_at)
    return v.withColumns({"page_type": kind, "application": app, "detail": detail, "route": F.when(kind == "spa", route)}).drop("mark")


def breadcrumbs(regions: DataFrame) -> DataFrame:
    """Of each frame the first region that is a trail of pages, in parts: stream, frame, idx, crumbs."""
    t = F.trim("text")
    r = regions.where(_holds(t, CRUMBS[:3])).groupBy("stream", "frame").agg(F.min(F.struct("idx", t.alias("t"))).alias("f"))
    mark = F.lit(CRUMBS[-1])
    for c in reversed(CRUMBS):
        mark = F.when(F.contains("f.t", F.lit(c)), c).otherwise(mark)
    parts = F.filter(F.transform(F.split(F.col("f.t"), F.concat(F.lit("["), mark, F.lit("]"))), lambda p: F.trim(p)), lambda p: p != "")
    return r.select("stream", "frame", "f.idx", parts.alias("crumbs"))


def navigation_history(visits: DataFrame, order: str = "page_id", most: int = 5) -> DataFrame:
    """Each visit of a host with the urls of its last five."""
    w = Window.partitionBy("host").orderBy(order).rowsBetween(1 - most, 0)
    return visits.withColumn("history", F.collect_list("url").over(w))


def page_structure(pages_table: DataFrame) -> DataFrame:
    """Counts of headings, links, forms, buttons and list items of each page's html."""
    n = lambda tag: F.regexp_count("html", F.lit(f"(?i)<{tag}[\\s>]")).cast("long")
    return pages_table.select("page_id", n("h[1-6]").alias("headings"), n("a").alias("links"), n("form").alias("forms"), n("button").alias("buttons"), n("li").alias("items"), n("p").alias("paragraphs"))


def screen_structure(regions: DataFrame) -> DataFrame:
    """Per frame: headings, form labels, buttons and links among its regions, its form's field names in order of height, and its
    title, the highest text of 6 to 99 characters in the upper 200 points that is neither label nor button."""
    r = _read(regions, None).select("stream", "frame", "idx", "y", "t", F.expr(FORM_LABEL).alias("label"), F.expr(FORM_BUTTON).alias("button"), F.expr(LINK).alias("link"), F.expr(HEADING).alias("heading"))
    name = F.replace(F.lower(F.expr("trim(BOTH ':*' FROM t)")), F.lit(" "), F.lit("_"))
    titled = (F.length("t") > 5) & (F.length("t") < 100) & (F.col("y") < 200) & ~F.col("label") & ~F.col("button")
    g = r.groupBy("stream", "frame").agg(
        F.count("heading").alias("headings"), F.count_if("label").alias("labels"), F.count_if(F.col("button") & ~F.col("label")).alias("buttons"), F.count_if("link").alias("links"),
        F.array_sort(F.collect_list(F.when(F.col("label"), F.struct("y", "idx", name.alias("name"))))).alias("of"), F.min(F.when(titled, F.struct("y", "idx", "t"))).alias("top"),
    )
    return g.select("stream", "frame", "headings", "labels", "buttons", "links", F.transform("of", lambda s: s["name"]).alias("fields"), F.col("top.t").alias("title"))


def terminal_metrics(commands: DataFrame) -> DataFrame:
    """Per stream: commands, their number a minute (null at once), the share of productive ones, the share with sudo."""
    minutes = (F.max("frame") - F.min("frame")) / 60
    g = commands.groupBy("stream").agg(
        F.count("*").alias("commands"), minutes.alias("minutes"), F.round(F.avg(F.col("command").isin(*PRODUCTIVE).cast("double")), 6).alias("productivity"), F.round(F.avg(F.col("sudo").cast("double")), 6).alias("sudo_share"))
    return g.select("stream", "commands", F.round(F.when(F.col("minutes") > 0, F.col("commands") / F.col("minutes")), 6).alias("per_minute"), "productivity", "sudo_share")


def workflow_patterns(commands: DataFrame, last: int = 5) -> DataFrame:
    """The first time that the last five commands of a stream show a pattern: git twice, a build, three of files."""
    w = Window.partitionBy("stream").orderBy("frame", "idx").rowsBetween(1 - last, 0)
    c = commands.withColumn("recent", F.collect_list("command").over(w))
    n = lambda names: F.size(F.filter("recent", lambda x: x.isin(*names)))
    kinds = F.size(F.array_distinct(F.filter("recent", lambda x: x.isin(*FILE_COMMANDS))))
    found = F.array_compact(F.array(F.when(n(("git",)) >= 2, "git_workflow"), F.when(n(BUILDS) >= 1, "build_workflow"), F.when(kinds >= 3, "file_management")))
    return c.select("stream", "frame", "idx", F.explode(found).alias("pattern")).groupBy("stream", "pattern").agg(F.min(F.struct("frame", "idx")).alias("first")).select("stream", "pattern", "first.frame", "first.idx")


def session_patterns(commands: DataFrame) -> DataFrame:
    """What the commands of a stream are for, all that hold: web development, containers, remote work, looking at files."""
    g = commands.groupBy("stream").agg(F.count("*").alias("commands"), F.collect_set("command").alias("names"), F.count_if(F.col("command").isin(*EXPLORING)).alias("looks"))
    has_one = lambda *names: F.arrays_overlap("names", F.array(*map(F.lit, names)))
    found = F.array_compact(F.array(F.when(has_one("git") & has_one("npm", "yarn"), "web_development"), F.when(has_one("docker", "kubectl"), "containerization"), F.when(has_one("ssh", "scp"), "remote_administration"), F.when(F.col("looks") >= 3, "file_exploration")))
    return g.select("stream", "commands", found.alias("patterns"))


def amounts(regions: DataFrame) -> DataFrame:
    """Money, percent and time amounts of regions that hold any."""
    r = regions.select("stream", "frame", "idx", T.amount(F.col("text")).alias("money"), T.percent(F.col("text")).alias("percent"), T.minutes(F.col("text")).alias("minutes"))
    return r.where("money is not null or percent is not null or minutes is not null")


def form_groups(regions: DataFrame, reach: float = 50.0) -> DataFrame:
    """Runs of two or more regions down a frame, each less than `reach` below the one before: fields, half their number, and
    the form's type by their words."""
    w = Window.partitionBy("stream", "frame").orderBy("y", "idx")
    r = _read(regions, None).withColumn("fresh", (F.col("y") - F.lag(F.col("y") + F.col("h")).over(w) >= reach).cast("int"))
    r = r.withColumn("form", F.sum(F.coalesce("fresh", F.lit(0))).over(w))
    some = lambda *names: F.bool_or(F.expr(any_of(*names)))
    kind = F.when(some("login", "password"), "login_form").when(some("contact", "email"), "contact_form").when(some("payment", "card"), "payment_form").when(some("search"), "search_form").otherwise("general_form")
    g = r.groupBy("stream", "frame", "form").agg(F.count("*").alias("n"), kind.alias("form_type"), F.min("confidence").alias("confidence"))
    return g.where("n >= 2").select("stream", "frame", "form", F.expr("n div 2").alias("fields"), "form_type", "confidence")


def step_runs(regions: DataFrame) -> DataFrame:
    """Runs of two or more workflow steps on end down a frame: steps, type by their words, the lowest confidence."""
    w = Window.partitionBy("stream", "frame").orderBy("y", "idx")
    step = F.expr("(" + like("^[0-9]+[.]") + " OR " + like("^Step [0-9]+") + " OR " + any_of("then", "next") + ")")
    r = _read(regions, None).withColumn("step", step).withColumn("run", F.sum((~F.col("step")).cast("int")).over(w)).where("step")
    some = lambda name: F.bool_or(F.expr(any_of(name)))
    kind = F.when(some("approve"), "approval_workflow").when(some("review"), "review_workflow").when(some("test"), "testing_workflow").when(some("deploy"), "deployment_workflow").otherwise("general_workflow")
    g = r.groupBy("stream", "frame", "run").agg(F.count("*").alias("steps"), kind.alias("pattern_type"), F.min("confidence").alias("confidence"))
    return g.where("steps >= 2")
