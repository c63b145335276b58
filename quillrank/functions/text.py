"""Text functions as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that results depend on.
CJK = "[\\u4e00-\\u9fff]"
SMALL_TALK = (
    "谢谢|好的|嗯|哦|OK|好|知道了|了解|明白|收到|thanks?|okay|got it|"
    "well done|great|nice|awesome|cool|讲得.*好|说得.*好|不错|可以|行|"
    "不客气|没关系|没.?事|不用.?谢|再见|拜拜|bye|hello|hi|hey|"
    "早上好|下午好|晚上好|good morning|good afternoon|good evening|"
    "晚安|good night|好梦|哈哈+|嘻嘻|嘿嘿|呵呵+|"
    "测试一下|test|测试"
)
SECURITY_FLAGS = (
    ("SHELL_PIPE", r"(?i)(curl|wget)\s+.*\|.*(bash|sh|python)"),
    ("CODE_EXEC", r"(?i)eval\s*\(|exec\s*\(|__import__\s*\("),
    ("DESTRUCTIVE_CMD", r"(?i)rm\s+-rf\s+/|sudo\s+rm"),
    ("REMOTE_EXEC", r"(?i)(github\.com|gitlab\.com).*raw.*\.(sh|py|exe)"),
    ("BASE64_BLOB", r"[a-zA-Z0-9+/]{40,}={0,2}"),
    ("HARDCODED_SECRET", r"""(?i)(password|secret|token|api_key|apikey)\s*[:=]\s*["']?\w{8,}"""),
)


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def ascii_tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words of two characters or more."""
    return F.array_distinct(_all(F.lower(F.coalesce(c, F.lit(""))), "[a-z0-9]{2,}"))


def tokens(c: Column) -> Column:
    """Set of tokens: ASCII words, short letter runs with an optional #suffix, CJK pairs, CJK spans of two to six."""
    low = F.lower(F.coalesce(c, F.lit("")))
    short = _all(low, "(?<![a-z])[a-z]{1,3}(?:#[a-z]+)?(?![a-z])")
    pairs = F.flatten(F.transform(_all(low, f"{CJK}{{2,}}"), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))))
    return F.array_distinct(F.concat(_all(low, "[a-z0-9]{2,}"), short, pairs, _all(low, f"{CJK}{{2,6}}")))


def ascii_words(c: Column) -> Column:
    """Bag of lower-case ASCII words of two characters or more."""
    return _all(F.lower(F.coalesce(c, F.lit(""))), "[a-z0-9]{2,}")


def query_hash(c: Column) -> Column:
    """Twelve hex digits of a query's first five concept words, or of its first thirty characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = _all(low, f"[a-z]{{3,}}|{CJK}{{2,4}}")
    key = F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, 5), " ")).otherwise(F.substring(low, 1, 30))
    return F.substring(F.md5(key.cast("binary")), 1, 12)


def discovery_tokens(c: Column, stop_words: list[str]) -> Column:
    """Bag of candidate terms: words of three letters or more with -/ compounds, CJK spans, CamelCase and snake_case parts."""
    text = F.coalesce(c, F.lit(""))
    low = F.lower(text)
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    keep = lambda a: F.filter(a, lambda t: ~F.array_contains(stop, t))
    camel = F.transform(_all(text, r"\b(?:[A-Z][a-z]+){2,}\b"), lambda t: F.lower(t))
    snake = F.flatten(F.transform(_all(text, r"\b[a-z]+(?:_[a-z]+)+\b"), lambda t: F.filter(F.split(t, "_"), lambda p: F.length(p) >= 3)))
    return F.concat(keep(_all(low, r"\b[a-z]{3,}(?:[-/][a-z]{2,})*\b")), keep(_all(low, f"{CJK}{{2,6}}")), camel, keep(snake))


def keyword_tokens(c: Column, terms: list[str] = ()) -> Column:
    """Bag of ASCII words, each listed term that the text holds (once), and CJK spans."""
    low = F.lower(F.coalesce(c, F.lit("")))
    held = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return F.concat(_all(low, "[a-z0-9]{2,}"), F.filter(held, lambda t: F.contains(low, t)), _all(low, f"{CJK}{{2,6}}"))


def is_task(c: Column) -> Column:
    """False for small talk, single characters and texts of emoji or punctuation only."""
    t = F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[!！。，,\.\s]+$", ""))
    empty = (F.length(t) <= 1) | t.rlike(f"(?i)^(?:{SMALL_TALK})$") | t.rlike(r"^(?U)[\x{1F300}-\x{1F9FF}\x{2700}-\x{27BF}\W]+$")
    return ~empty


def security_flags(c: Column) -> Column:
    """Labels of the patterns found, in fixed order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in SECURITY_FLAGS]))


def code_keywords(c: Column, most: int = 30) -> Column:
    """Import targets, decorators, class name parts and public function name parts; sorted, the first `most`."""
    text = F.coalesce(c, F.lit(""))
    low = lambda a: F.transform(a, lambda t: F.lower(t))
    imports = F.filter(low(_all(text, r"(?:import|from)\s+(\w+)", 1)), lambda t: F.length(t) >= 2)
    classes = F.flatten(F.transform(_all(text, r"class\s+(\w+)", 1), lambda t: _all(t, "[A-Z][a-z]+")))
    public = F.filter(_all(text, r"def\s+(\w+)", 1), lambda t: ~t.startswith("_"))
    functions = F.flatten(F.transform(public, lambda t: _all(F.lower(t), "[a-z]{3,}")))
    return F.slice(F.array_sort(F.array_distinct(F.concat(imports, low(_all(text, r"@(\w+)", 1)), low(classes), functions))), 1, most)


def symbol_parts(c: Column, stop_words: list[str] = ()) -> Column:
    """Camel and snake parts of a symbol of three letters or more."""
    parts = F.transform(_all(c, "[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), lambda t: F.lower(t))
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def matches_query(query: Column, text: Column) -> Column:
    """At least half (rounded down, one at least) of the query's words are substrings of the text."""
    words = F.array_distinct(_all(F.lower(query), r"(?U)\w{2,}"))
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: F.contains(low, w))) >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))


def slug(c: Column) -> Column:
    """A feature key: other characters become _, 30 at most, none at the ends."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), 1, 30), "^_+|_+$", "")


def decayed(boost: Column, ts: Column, now: Column, half_life_days: float = 7.0) -> Column:
    """A boost that halves every `half_life_days`."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86400e6
    return boost * F.pow(F.lit(0.5), age / F.lit(max(half_life_days, 0.1)))


def min_max(score: Column, low: Column, high: Column) -> Column:
    return F.when(high - low > 1e-10, (score - low) / (high - low)).otherwise(0.0)


def clamp_method(method, known: list[str], default: str = "hybrid") -> str:
    """A requested method's name, or the default for an unknown one."""
    name = str(method or "").strip().lower()
    return name if name in known else default


def clamp_k(k, default: int = 5) -> int:
    """A requested result count, held in 1..100."""
    try:
        return min(100, max(1, int(k)))
    except (TypeError, ValueError):
        return default
