"""Scalar functions over ids, class names and paths, as column expressions."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: namespace segments that name no domain.
STOP_SEGMENTS = ("Application", "Domain", "Infrastructure", "Event", "Payload")
#: Fixed: folders that a scan never enters, and what it ignores by default.
PRUNED = ("vendor", "node_modules", ".git", "var")
IGNORED = ("vendor/", "var/", "node_modules/", ".git/", "tests/fixtures/", "*.generated.php")
#: Fixed: risk of a class by its name's ending.
RISK_SUFFIX = {"Service": 0.15, "Handler": 0.1, "Manager": 0.1, "Facade": 0.2, "Kernel": 0.25}
#: Fixed: domains and the words that point to them, in the order in which they are tried.
DOMAIN_WORDS = {
    "Auth": ("auth", "login", "register", "permission", "capability", "rbac"),
    "Billing": ("billing", "invoice", "payment", "subscription", "pricing"),
    "Inventory": ("inventory", "stock", "product", "warehouse", "sku"),
    "Ordering": ("order", "cart", "checkout", "fulfillment", "shipping"),
    "Notification": ("notification", "email", "sms", "push", "alert"),
    "Media": ("media", "image", "video", "upload", "storage", "asset"),
    "Search": ("search", "index", "query", "filter", "facet"),
    "Analytics": ("analytics", "metric", "report", "dashboard", "tracking"),
    "User": ("user", "profile", "account", "preference", "avatar"),
    "Content": ("content", "page", "article", "post", "cms", "block"),
    "Tenancy": ("tenant", "organization", "workspace", "team"),
    "Workflow": ("workflow", "process", "approval", "state", "transition"),
    "Scheduler": ("schedule", "cron", "job", "task", "timer"),
    "Ledger": ("ledger", "event", "propagat", "replay", "sequence"),
    "Cache": ("cache", "redis", "ttl", "invalidat"),
    "Locale": ("locale", "language", "translation", "i18n", "l10n"),
}
#: Fixed: domains whose failure is critical.
CRITICAL_DOMAINS = ("Auth", "Billing", "Ordering", "Tenancy", "Ledger")
#: Fixed: words of a task that bring others with them, in the order in which they are tried.
SYNONYMS = {
    "payment": ("Payment", "Billing", "Checkout", "Stripe"),
    "checkout": ("Checkout", "Order", "Cart", "Payment"),
    "order": ("Order", "Checkout", "Fulfillment"),
    "user": ("User", "Auth", "Profile", "Account"),
    "auth": ("Auth", "Login", "Permission", "Capability"),
    "product": ("Product", "Inventory", "Catalog"),
    "inventory": ("Inventory", "Stock", "Product", "Warehouse"),
    "notification": ("Notification", "Email", "Alert"),
    "email": ("Email", "Notification", "Mail"),
}
#: Fixed: DOT colours of node types; others are grey.
COLOURS = {
    "payload": "#4CAF50", "handler": "#2196F3", "service": "#FF9800", "entity": "#9C27B0", "resource": "#00BCD4",
    "event_listener": "#E91E63", "event": "#F44336", "command": "#795548", "component": "#607D8B",
}
GREY = "#9E9E9E"


def short_name(fqcn: Column) -> Column:
    """What follows the last backslash."""
    return F.substring_index(fqcn, "\\", -1)


def fqcn_of_id(id_: Column) -> Column:
    """What follows the first colon, the whole id if it has none."""
    at = F.instr(id_, ":")
    return F.when(at > 0, F.substring(id_, at + F.lit(1), F.length(id_))).otherwise(id_)


def snake_case(text: Column) -> Column:
    """An underscore before each capital but the first letter, all small."""
    return F.lower(F.regexp_replace(text, r"(?<!^)([A-Z])", "_$1"))


def spaced_words(text: Column) -> Column:
    """A blank before each capital but the first letter, all small."""
    return F.lower(F.regexp_replace(text, r"(?<!^)([A-Z])", " $1"))


def studly_case(text: Column) -> Column:
    """The words between signs, each with a capital, joined; the other letters stay as they are."""
    parts = F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def module_of_path(path: Column) -> Column:
    """The package's name of a path under packages/, App under src/ or tests/, else empty."""
    package = F.regexp_extract(path, r"(?:^|/)packages/([^/]+)/", 1)
    return F.when(package != "", studly_case(package)).when(path.rlike(r"(^|/)(src|tests)/"), "App").otherwise("")


def domain_segment(namespace: Column) -> Column:
    """The last segment that names a domain, small; empty if none does."""
    parts = F.filter(F.split(namespace, r"\\"), lambda p: (p != "") & ~p.isin(*STOP_SEGMENTS))
    return F.when(F.size(parts) > 0, F.lower(F.element_at(parts, -1))).otherwise("")


def event_domain(fqcn: Column) -> Column:
    """The domain of an event's class: the last segment of its namespace that names one, else its short name without Event or Payload, small."""
    segment = domain_segment(F.regexp_replace(fqcn, r"\\?[^\\]*$", ""))
    return F.when(segment != "", segment).otherwise(F.lower(F.regexp_replace(short_name(fqcn), "(Event|Payload)$", "")))


def flow_name(fqcn: Column) -> Column:
    """The short name without Payload, Request or Command at its end, with Flow."""
    return F.concat(F.regexp_replace(short_name(fqcn), "(Payload|Request|Command)$", ""), F.lit("Flow"))


def module_key(id_: Column, vendor: str) -> Column:
    """The first part of a class name without the id's prefix; the second if the first is the vendor's."""
    parts = F.split(fqcn_of_id(id_), r"\\")
    return F.when((parts[0] == vendor) & (F.size(parts) > 1), parts[1]).otherwise(parts[0])


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4)


def infer_domain(module: Column) -> Column:
    """The domain that is a word of the module's name; else the first one of which a word stands in it; else the name, its words with capitals."""
    low = F.lower(module)
    named = F.filter(F.transform(F.split(low, "[-_ ]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), lambda w: w.isin(*DOMAIN_WORDS))
    tried = [F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(d)) for d, words in DOMAIN_WORDS.items()]
    titled = F.array_join(F.transform(F.split(module, "[-_ ]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.coalesce(F.get(named, F.lit(0)), *tried, titled)


def name_risk(name: Column) -> Column:
    """The part of a class's risk that its name's ending makes."""
    return reduce(lambda c, kv: c.when(name.endswith(kv[0]), kv[1]), RISK_SUFFIX.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def is_pruned(path: Column) -> Column:
    """Whether a scan never enters the path's folder."""
    return path.rlike("(^|/)(" + "|".join(re.escape(p) for p in PRUNED) + ")/")


def is_ignored(path: Column, patterns: tuple[str, ...] = IGNORED) -> Column:
    """Whether a pattern hits a relative path: a folder's name ending in / at its start, else a glob on its last part. Empty lines and # comments are none."""
    tests = []
    for p in (p.strip() for p in patterns):
        if p and not p.startswith("#"):
            tests.append(path.startswith(p) if p.endswith("/") else F.substring_index(path, "/", -1).rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z") + "$"))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def keywords(text: str, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> list[str]:
    """The words of three letters and more of a task, each also with a capital; synonyms are added in order, those that they bring in turn included."""
    out: list[str] = []
    for word in re.split(r"[\s\-_]+", text):
        if len(word) >= 3:
            out += [word, word.lower().capitalize()]
    for trigger, more in synonyms.items():
        if any(trigger in w.lower() for w in out):
            out += more
    return list(dict.fromkeys(out))


def first_capital(text: Column) -> Column:
    """The text with its first letter as a capital."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def date_text(epoch: Column) -> Column:
    """Seconds since 1970 as yyyy-MM-dd HH:mm:ss in the session's zone; null stays null."""
    return F.date_format(F.timestamp_seconds(epoch.cast("long")), "yyyy-MM-dd HH:mm:ss")


def colour(type_: Column) -> Column:
    """The DOT colour of a node type."""
    return reduce(lambda c, kv: c.when(type_ == kv[0], kv[1]), COLOURS.items(), F.when(F.lit(False), "")).otherwise(GREY)
