"""Quality gates for facts, importance, grounding and relation heuristics, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import _text, is_arabic, is_arabic_heavy, norm_store, normalize_whitespace
from memloom.schema import FACT_CATEGORIES, RELATION_KINDS

# Phrases that say nothing.
SKIP_PHRASES = [
    "help was provided", "assistant helped", "conversation was about", "system was built", "all dependencies", "instructions were sent",
    "no technical details", "no specific", "no explicit", "the user asked", "user asked a", "the conversation was", "the assistant was", "no code or technical",
    "المحادثة كانت حول", "تم تقديم المساعدة", "تم التحقق من", "تم بناء النظام", "تم تثبيت جميع", "تم ارسال تعليمات", "لا توجد تفاصيل", "لا يوجد", "لم يتم",
    "was not involved", "was not used", "is not used", "not relevant", "not related", "did not involve", "was not part", "not directly", "no changes", "no issues", "no problems",
    "nothing to report", "no action", "no updates",
    "لم يتم استخدام", "لم يكن", "ليس جزءا", "غير مستخدم", "غير مرتبط", "لا يتعلق", "لا تأثير", "لم يشارك", "غير مباشر", "غير معني", "لا مشاكل", "لا تغييرات",
    "غير متصل", "غير موجود", "لم يشارك في", "ليس له علاقه",
]
# Words that figures go with.
STAT_WORDS = [
    "nodes", "edges", "vertices", "modularity", "clusters", "communities", "components", "degree", "density", "diameter", "centrality",
    "lines", "bytes", "files", "directories", "functions", "classes", "parameters", "variables", "tokens", "words", "characters",
    "records", "rows", "columns", "entries", "items", "sessions", "messages", "connections", "requests", "responses",
    "node", "edge", "vertex", "cluster", "community", "component", "line", "file", "directory", "function", "class",
    "record", "row", "column", "entry", "item", "session", "message", "connection", "request", "response", "key", "keys", "fact", "facts",
    "عقد", "حواف", "رؤوس", "وحدات", "مجموعات", "مكونات", "أسطر", "بايت", "ملفات", "مجلدات", "دوال", "أصناف", "رموز", "كلمات", "أحرف", "سجلات", "صفوف", "أعمدة",
    "جلسات", "رسائل", "اتصالات", "طلبات", "عقدة", "حافة", "ملف", "مجلد", "دالة", "صنف", "رمز", "كلمة", "حرف", "سجل", "صف", "عمود",
    "جلسة", "رسالة", "اتصال", "طلب", "مفتاح", "مفاتيح", "حقيقة", "حقائق",
]


def any_of_words(words: list[str]) -> str:
    """A pattern for any of the words that shares their common beginnings, so that a place in a text is tried once and not once a word."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def told(node: dict) -> str:
        ways = [(re.escape(c) if c != " " else c) + told(n) for c, n in sorted(node.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{body})?" if "" in node else body

    return told(root)


_KW = any_of_words(STAT_WORDS)
# Snapshots of figures, in English and in normalised Arabic, and names of secrets.
STAT_ENGLISH = [
    r"(?:number\s+of|total|count\s+of|average|mean)\s+.+?\s*(?:is|:|=|was)\s*[\d,.]+",
    r"\b\w+\s+(?:score|value|index|dimension|count|total|amount|size|number|percentage|distribution)\s+(?:is|:|=|was)\s*[\d,.]+",
    rf"\d+(?:[.,]\d+)*\s+(?:{_KW})(?:\s|,|$)",
    rf"\b(?:{_KW})\s+(?:is|:|=|was|of|has|in|are)\s*[\d,.]+",
    r"[\d,.]+\s*%",
]
STAT_ARABIC = [r"(?:عدد|اجمالي|مجموع|متوسط)\s+\S+?\s*[:=]\s*[\d,.]+", r"(?:عدد|اجمالي|مجموع|متوسط)\s+\S+?\s+(?:هو|يساوي)\s*[\d,.]+"]
# What the first pattern, in which any text may lie, begins with.
STAT_STARTS = ["number", "total", "count", "average", "mean"]
SENSITIVE = r"\b[A-Z_]{2,40}(?:KEY|TOKEN|SECRET|PASSWORD|API_KEY|BOT_TOKEN)\b"
CJK = "[一-鿿㐀-䶿぀-ゟ゠-ヿ가-힯]"
LEAST_ARABIC, LEAST_OTHER = 10, 20


def words(c: Column) -> Column:
    """Parts between white space; none for blank text."""
    return F.filter(F.split(normalize_whitespace(c), " "), lambda w: w != "")


def is_sensitive(c: Column | str) -> Column:
    """The name of a secret, alone or in up to five words."""
    c = F.trim(F.coalesce(_text(c), F.lit("")))
    return c.rlike(r"^[A-Z_]{3,}$") | (c.rlike(f"(?U){SENSITIVE}") & (F.size(words(c)) <= 5))


def is_cjk(c: Column | str) -> Column:
    return F.coalesce(_text(c).rlike(CJK), F.lit(False))


def _skip_pattern() -> str:
    """All phrases in the stored form that texts are compared in, for SQL."""
    fold = str.maketrans("إأآٱىة", "اااايه")
    return any_of_words([p.lower().translate(fold) for p in SKIP_PHRASES])


def _has_phrase(stored: Column) -> Column:
    """One of the phrases is in a text, both in stored form. Plain searches are faster than a pattern of all; Arabic ones are made where there are such letters."""
    fold = str.maketrans("إأآٱىة", "اااايه")
    phrases = list(dict.fromkeys(p.lower().translate(fold) for p in SKIP_PHRASES))
    phrases = [p for p in phrases if not any(q != p and q in p for q in phrases)]
    held = lambda some: reduce(lambda a, b: a | b, (F.contains(stored, F.lit(p)) for p in some))
    return held([p for p in phrases if p.isascii()]) | (is_arabic(stored) & held([p for p in phrases if not p.isascii()]))


def _has_figures(low: Column, stored: Column) -> Column:
    """A snapshot of figures. Each pattern is tried where what it can't do without is in the text: these are cheap to look for."""
    found = lambda col, pattern: F.coalesce(col.rlike(f"(?U){pattern}"), F.lit(False))
    any_in = lambda col, some: reduce(lambda a, b: a | b, (F.contains(col, F.lit(w)) for w in some))
    total, scored, counted, named, share = STAT_ENGLISH
    told = found(low, r"\s(?:is|:|=|was|of|has|in|are)\s*[\d,.]")
    english = (any_in(low, STAT_STARTS) & found(low, total)) | (told & (found(low, scored) | found(low, named))) | found(low, counted) | (any_in(low, ["%"]) & found(low, share))
    return english | (is_arabic(stored) & (found(stored, STAT_ARABIC[0]) | found(stored, STAT_ARABIC[1])))


def junk_rule(c: Column | str) -> Column:
    """Which gate rejects a fact, or null if none does: the first that applies.

    The trimmed, lower-cased and stored forms are made once and bound for all rules.
    """
    c = normalize_edges(F.coalesce(_text(c), F.lit("")))
    forms = bound(c, lambda t: bound(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: F.struct(x["t"].alias("t"), x["low"].alias("low"), norm_store(x["low"]).alias("stored"))))
    return bound(forms, lambda x: _first_rule(x["t"], x["low"], x["stored"]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first_rule(c: Column, low: Column, stored: Column) -> Column:
    length = F.length(c)
    # Figures weigh only beside a word that goes with them, which is looked for where they do.
    solid = F.replace(c, F.lit(" "), F.lit(""))
    figures = F.length(F.regexp_replace(solid, r"(?U)[^\d.,]+", "")) / F.length(solid)
    stat_word = F.arrays_overlap(words(low), F.array(*(F.lit(w) for w in STAT_WORDS)))
    return (
        F.when(c == "", "empty")
        .when(is_sensitive(c), "sensitive")
        .when(is_cjk(c), "cjk")
        .when((length < LEAST_ARABIC) | ((length < LEAST_OTHER) & ~is_arabic_heavy(c)), "short")
        .when(_has_phrase(stored), "phrase")
        .when(c.rlike(r"(?U)^\d+\s+\w+$"), "count")
        .when(c.rlike(r"(?U)^تم\s+\w+\s*$"), "passive")
        .when(c.rlike(r"^[a-z][a-z0-9_]{15,}$"), "snake")
        .when(_has_figures(low, stored), "figures")
        .when((figures > 0.30) & stat_word, "digits")
    )


def normalize_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_junk(c: Column | str) -> Column:
    return junk_rule(c).isNotNull()


def language_fits(fact: Column | str, arabic_session: Column) -> Column:
    """A fact in its session's language; mixed facts fit both."""
    fact = F.coalesce(_text(fact), F.lit(""))
    some = is_arabic_heavy(fact, 0.1)
    arabic = some | ~fact.rlike(r"^\p{ASCII}*$")
    other = ~is_arabic_heavy(fact, 0.5)
    return (fact != "") & F.when(arabic_session, arabic).otherwise(other)


def category_of(c: Column | str, known: list[str] = FACT_CATEGORIES) -> Column:
    return F.when(_text(c).isin(known), _text(c)).otherwise(F.lit("general"))


def storable(key: Column | str, arabic_session: Column, least: int = 15) -> Column:
    """What a summary's fact must pass before it is stored."""
    key = F.trim(F.coalesce(_text(key), F.lit("")))
    return (F.length(key) >= least) & ~is_junk(key) & language_fits(key, arabic_session)


# What makes a session important, and how much.
BOOSTS = {
    "security": 2, "api_key": 2, "token": 2, "secret": 2, "password": 2, "preference": 1, "prefer": 1, "decision": 1, "decided": 1,
    "config": 1, "configuration": 1, "settings": 1, "bug": 1, "fix": 1, "fixed": 1, "error": 1, "crash": 1, "migration": 1, "backup": 1, "restore": 1,
    "data loss": 2, "breaking": 2, "breaking change": 2, "deploy": 1, "deployment": 1, "production": 1, "remove": 1, "delete": 1, "cleanup": 1,
    "refactor": 1, "rewrite": 1, "redesign": 1, "threshold": 1, "community": 1, "graph": 1, "authentication": 1, "auth": 1, "permission": 1, "access": 1, "role": 1,
    "تفضيل": 1, "قرار": 1, "خطأ": 1, "إصلاح": 1, "أمان": 2, "مفتاح": 1, "نقل": 1, "نسخة احتياطية": 1, "إعداد": 1,
}


def boost_of(text: Column) -> Column:
    """The largest boost of a keyword in a lower-case text, else 0: one test a level."""
    level = lambda n: text.rlike("|".join(re.escape(k).replace(r"\ ", " ") for k, b in BOOSTS.items() if b == n))
    return F.when(level(2), 2).when(level(1), 1).otherwise(0)


def importance(boost: Column, n_words: Column, thanks: Column, has_facts: Column, model: Column) -> Column:
    """0 to 5 from keywords, else the model's guess; thanks alone are worth 1 at most, facts 2 at least."""
    score = F.when(boost >= 2, 5).when(boost == 1, 4).otherwise(model)
    score = F.when((n_words < 50) & thanks, F.least(score, F.lit(1))).otherwise(score)
    score = F.when(has_facts & (score < 2), 2).otherwise(score)
    return F.greatest(F.lit(0), F.least(F.lit(5), score)).cast("int")


def grounding(fact: Column, heard: Column) -> Column:
    """The share of a fact's words, of three characters or more, that contain or are contained in a heard word; 0 without any."""
    told = F.array_distinct(F.filter(words(F.lower(fact)), lambda w: F.length(w) > 2))
    found = F.filter(told, lambda w: F.exists(heard, lambda h: h.contains(w) | w.contains(h)))
    return F.when(F.size(told) > 0, F.size(found) / F.size(told)).otherwise(F.lit(0.0))


# The words behind relation guesses.
FIX_WORDS = ["حل", "fix", "repair", "إصلاح", "معالجة", "عالج"]
PROBLEM_WORDS = ["مشكلة", "خطأ", "error", "problem", "bug", "فشل"]
CONTRARY_WORDS = ["لكن", "but", "however", "عكس", "تناقض", "instead"]
CAUSE_WORDS = ["بسبب", "because", "لذلك", "therefore", "أدى", "causes", "يؤدي"]


def relation(a: Column | str, b: Column | str) -> Column:
    """A guess ``(kind, confidence, reason)`` about two facts, or null."""
    a, b = F.lower(F.coalesce(_text(a), F.lit(""))), F.lower(F.coalesce(_text(b), F.lit("")))
    has = lambda c, names: c.rlike("|".join(names))
    guess = lambda kind, p, why="heuristic": F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("confidence"), F.lit(why).alias("reason"))
    shared = F.size(F.array_intersect(words(a), words(b)))
    return (
        F.when(has(a, FIX_WORDS) & has(b, PROBLEM_WORDS), guess("fixes", 0.35))
        .when(has(a, CONTRARY_WORDS) | has(b, CONTRARY_WORDS), guess("contradicts", 0.3))
        .when(has(a, CAUSE_WORDS) | has(b, CAUSE_WORDS), guess("causes", 0.35))
        .when(shared >= 2, guess("related", 0.25, "shared_words"))
    )


def checked_relation(answer: Column | str) -> Column:
    """A model's JSON answer: unknown kinds become related, none and bad JSON null."""
    got = F.from_json(_text(answer), "relation_type string, confidence double, reasoning string")
    kind = F.lower(got["relation_type"])
    out = F.struct(F.when(kind.isin(RELATION_KINDS), kind).otherwise("related").alias("kind"), F.coalesce(got["confidence"], F.lit(0.5)).alias("confidence"), got["reasoning"].alias("reason"))
    return F.when(kind.isNotNull() & (kind != "none"), out)


def decision(similarity: Column, label: Column, same: float = 0.95) -> Column:
    """``add``, ``update``, ``contradict`` or ``noop`` from the best similarity and a model's label (null: no answer)."""
    label = F.lower(F.trim(label))
    chosen = (
        F.when(label.isin("add", "new"), "add")
        .when(label.isin("update", "refine", "modify"), "update")
        .when(label.isin("contradict", "contradiction", "delete"), "contradict")
        .otherwise("noop")
    )
    return F.when(similarity.isNull(), "add").when(similarity > same, "noop").when(label.isNull(), "add").otherwise(chosen)


def session_is_arabic(ratio: Column, more: float = 0.30) -> Column:
    return ratio > more
