"""Text functions: market rules, speakers, phrase labels and transcript tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values. Results depend on these exact lists and patterns.

SPORTS_TOKENS = ("NFL", "NBA", "NCAA", "MLB", "NHL", "UFC", "WWE", "MMA", "BOXING", "FIGHT",
                 "DRAFT", "GOLF", "TENNIS", "SOCCER", "FIFA", "WC", "ATHLETE")
ENTERTAINMENT_TOKENS = ("DWTS", "LOVEISLAND", "REALITY", "SURVIVOR", "BACHELOR", "OSCARS",
                        "GRAMMY", "SNL")
ENTERTAINMENT_TITLES = ("dwts", "love island")
BROADCAST_TOKENS = ("FTN", "MTP", "FACENATION", "MEETPRESS", "THEVIEW", "FIRSTTAKE")
BROADCAST_TITLES = ("face the nation", "meet the press", "the view", "first take", "squawk",
                    "cnbc", "espn", "state of play", "nintendo direct", "podcast", "late night")

# Wording of the notes column.
NOTE_WINDOW_VIDEO = "windowed statement, no canonical video → outlet-miss risk"
NOTE_WINDOW_SPARSE = "windowed statement, sparse approved sources → high miss risk"
NOTE_VIDEO = "video/transcript-primary resolution → low approved-outlet-miss risk"
NOTE_OUTLETS = " approved outlets → low miss risk"
NOTE_FEW_OUTLETS = ("only ", " approved source(s) → outlet-dependency risk")
NOTE_NO_SOURCE = "no governing source declared"
NOTE_UNKNOWN = "unrecognized rule template — needs manual parse; "
NOTE_VAGUE = ("; +", " ambiguity")
NOTE_PLURAL = "plural/possessive accepted"
NOTE_NQE = "qualifying-event-does-not-occur leg (cancellation clause); not a phrase pred"

SPEECH_RULE = (r"^If (.+?) says (.+?) (?:as part of|at) (.+?)"
               r"\s*,?\s*then the market resolves to Yes\.?$")
EARNINGS_RULE = (r"^If (.+?) is said by any (.+?) representative.*?"
                 r"during the next .+? earnings call.*?then the market resolves to Yes\.?$")
DURATION_RULE = (r"^If (.+?)(?:, or a plural or possessive form of [^,]+?)?, is stated by "
                 r"(.+?) ((?:before|after|between) .+?)"
                 r"\s*,?\s*then the market resolves to Yes\.?$")
LENGTH_RULE = r"^If .+? speaks for .+? minutes at .+?, then the market resolves to Yes\.?$"
SUPERLATIVE_RULE = (r"^If (.+?) mentions the topic of (.+?) most as part of (.+?)"
                    r"\s*,?\s*then the market resolves to Yes\.?$")
COUNT_SUFFIX = r"\(\s*(\d+)\s*\+?\s*times?\s*\)"

SPEAKER_ALIASES = {
    "powell": "jerome powell",
    "jerome powell": "jerome powell",
    "chair powell": "jerome powell",
    "the chair of the federal reserve": "jerome powell",
    "the federal reserve chair": "jerome powell",
    "fed chair": "jerome powell",
    "fed": "jerome powell",
}
SPEAKER_TITLES = (r"(?:vice )?(?:president|chair(?:man)?(?:\s+for\s+supervision)?|chairwoman|"
                  r"secretary|senator|governor|representative|the honorable|mr|mrs|ms|dr|sir|"
                  r"prime minister|pm|king|queen)\.?\s+")
EVENT_KINDS = ("rally", "presser", "press conference", "debate", "inaugural", "dinner",
               "ceremony", "meeting", "address")
VIDEO_ID = r"(?:v=|youtu\.be/|/live/|/embed/|/shorts/)([A-Za-z0-9_-]{11})"

EVENT_VOCABULARY = (r"\bgoal\b|goals|score|scores|scored|equalizer|equaliser|\d-\d|"
                    r"penalty kick|red card|sent off")
SINGLE_VARIANTS = {
    "champion": ["champions", "champion's"],
    "captain": ["captains", "captain's"],
    "comeback": ["comebacks"],
    "shutout": ["shutouts"],
    "record": ["records"],
    "equalizer": ["equalizers", "equalize", "equalized", "equalizes", "equalizing"],
    "suspend": ["suspended", "suspends", "suspension", "suspending"],
    "suspended": ["suspend", "suspends", "suspension"],
    "handball": ["handballs"],
    "nutmeg": ["nutmegs", "nutmegged"],
    "meg": ["megs", "megged"],
    "appeal": ["appealed", "appeals", "appealing"],
    "hattrick": ["hattricks"],
    "penalty": ["penalties"],
    "goal": ["goals"],
    "bicycle": ["bicycles"],
    "crossbar": ["crossbars"],
}
LAST_WORD_PLURALS = {
    "hat trick": "hat tricks",
    "red card": "red cards",
    "own goal": "own goals",
    "penalty kick": "penalty kicks",
    "golden boot": "golden boots",
    "come back": "come backs",
}
# ---------------------------------------------------------------------------------------------

BINARY_TEMPLATES = ("speech", "earnings", "duration")


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed, NULL as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _any_of(text: Column, needles: tuple[str, ...]) -> Column:
    return text.rlike("|".join(needles))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def market_format(series_ticker: Column, title: Column) -> Column:
    """Programme format from the series ticker and title."""
    code, name = F.upper(series_ticker), F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(_any_of(code, ("EARNINGS", "MENTIONEARN")) | name.contains("earnings"), "earnings")
        .when(_any_of(code, SPORTS_TOKENS), "sports")
        .when(_any_of(code, ENTERTAINMENT_TOKENS) | _any_of(name, ENTERTAINMENT_TITLES),
              "entertainment")
        .when(_any_of(code, BROADCAST_TOKENS) | _any_of(name, BROADCAST_TITLES), "broadcast")
        .otherwise("speech")
    )


def series_speaker(series_ticker: Column, title: Column) -> Column:
    """Coarse speaker label left after the boilerplate words of a series title."""
    words = r"(?iU)\b(earnings call|earnings mention|earnings|mention|call)\b"
    left = F.btrim(squeeze(F.regexp_replace(F.coalesce(title, F.lit("")), words, "")),
                   F.lit(" -–—:"))
    return F.when(left != "", left).otherwise(series_ticker)


def source_names(sources: Column) -> Column:
    """Non-blank names of an ``array<struct<name,...>>`` of settlement sources."""
    names = F.transform(F.coalesce(sources, F.array()), lambda s: F.trim(F.coalesce(s["name"], F.lit(""))))
    return F.filter(names, lambda n: n != "")


def rule_template(rules: Column, label: Column) -> Column:
    """Rule template of a market, first match wins."""
    text = squeeze(rules)
    nqe = (F.lower(F.trim(label)) == "event does not qualify") | F.lower(text).contains(
        "qualifying event does not occur")
    return (
        F.when(nqe, "nqe")
        .when(text.rlike(EARNINGS_RULE), "earnings")
        .when(text.rlike(LENGTH_RULE), "length")
        .when(text.rlike(SUPERLATIVE_RULE), "superlative")
        .when(text.rlike(DURATION_RULE), "duration")
        .when(text.rlike(SPEECH_RULE), "speech")
        .otherwise("other")
    )


def _split_label(label: Column) -> Column:
    parts = F.transform(F.split(label, "/"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def phrase_variant(label: Column) -> Column:
    """Matching rule class of an outcome label."""
    text = F.trim(F.coalesce(label, F.lit("")))
    parts = _split_label(text)
    stems = F.array_distinct(F.transform(
        parts, lambda p: F.substring(F.regexp_replace(F.lower(p), "[^a-z]", ""), 1, 4)))
    one_stem = (F.size(stems) == 1) & (F.try_element_at(stems, F.lit(1)) != "")
    return (
        F.when(text == "", "fuzzy")
        .when(text.rlike(f"(?i){COUNT_SUFFIX}"), "count_threshold")
        .when(text.contains("/") & (F.size(parts) >= 2) & one_stem, "plural_possessive")
        .when(text.contains("/"), "aliases_listed")
        .otherwise("exact")
    )


def speaker_key(name: Column) -> Column:
    """Join key of a speaker label: aliases, stacked titles and initials resolved (X11)."""
    text = F.lower(squeeze(name))
    bare = F.trim(F.regexp_replace(text, f"^(?:{SPEAKER_TITLES})+", ""))
    bare = F.btrim(squeeze(F.regexp_replace(bare, r"(?U)\b[a-z]\.", "")), F.lit(" ."))
    return F.coalesce(_lookup(SPEAKER_ALIASES, text), _lookup(SPEAKER_ALIASES, bare), bare)


def key_text(text: Column) -> Column:
    """Lower-case letters and digits, single-spaced."""
    return squeeze(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "))


def _quoted(word: Column) -> Column:
    return F.regexp_replace(word, r"([!-/:-@\[-`{-~])", r"\\$1")


def term_pattern(term: Column) -> Column:
    """Whole-word pattern of one alternate; its last word may be plural or possessive."""
    words = F.transform(F.split(squeeze(term), " "), _quoted)
    body = F.concat(F.array_join(words, r"\s+"), F.lit("(?:'s|’s|es|s)?"))
    return F.concat(F.lit("(?<![A-Za-z])"), body, F.lit("(?![A-Za-z])"))


def phrase_spec(label: Column) -> Column:
    """Outcome label to ``struct<alternates, variant, min_count, phrase_key, pattern>``.

    ``pattern`` is NULL when there is nothing to search for.
    """
    raw = F.trim(F.coalesce(label, F.lit("")))
    digits = F.regexp_extract(raw, f"(?i){COUNT_SUFFIX}", 1)
    count = F.greatest(F.lit(1).cast("bigint"), F.coalesce(digits.try_cast("bigint"), F.lit(1)))
    core = F.trim(F.regexp_replace(raw, f"(?i){COUNT_SUFFIX}", ""))
    alternates = _split_label(core)
    keys = F.array_sort(F.array_distinct(F.filter(
        F.transform(alternates, key_text), lambda k: k != "")))
    key = F.array_join(keys, "|")
    full_key = F.when((count > 1) & (key != ""), F.concat(key, F.lit("|>="), count.cast("string")))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform(alternates, term_pattern), "|"))
    return F.struct(
        alternates.alias("alternates"),
        phrase_variant(raw).alias("variant"),
        count.alias("min_count"),
        F.coalesce(full_key, key).alias("phrase_key"),
        F.when(F.size(alternates) > 0, pattern).alias("pattern"),
    )


def count_matches(text: Column, pattern: Column) -> Column:
    """Non-overlapping matches of a pattern; zero without a pattern or text."""
    return F.coalesce(F.regexp_count(text, pattern), F.lit(0)).cast("bigint")


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+")).cast("bigint")


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by ``|``."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *filled)), 1, 16)


@lru_cache(maxsize=1)
def _ascii_foldings() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions of the BMP that leave ASCII: one-to-one and longer ones."""
    src, dst, longer = [], [], {}
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(chr(point))
            dst.append(plain)
        elif plain:
            longer[chr(point)] = plain
    return "".join(src), "".join(dst), longer


def fold_ascii(text: Column) -> Column:
    """Accents and compatibility forms folded to ASCII, the rest dropped."""
    src, dst, longer = _ascii_foldings()
    folded = F.translate(text, src, dst)
    spread = F.array_join(F.transform(
        F.split(folded, ""), lambda c: F.coalesce(_lookup(longer, c), c)), "")
    multi = "[" + "".join(longer) + "]"
    wide = F.when(folded.rlike(multi), spread).otherwise(folded)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(wide, r"[^\x00-\x7F]", "")).otherwise(text)


def reprice_token(word: Column) -> Column:
    """Token form of the reprice matcher: ASCII, lower case, no possessive, no punctuation."""
    bare = F.regexp_replace(F.lower(fold_ascii(word)), r"'s\b", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def stem(token: Column) -> Column:
    """Token without its first fitting suffix of ing, ed, es, s."""
    out = None
    for suffix in ("ing", "ed", "es", "s"):
        fits = token.endswith(suffix) & (F.length(token) >= 3 + len(suffix))
        cut = F.left(token, F.length(token) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(token)


def qa_token(word: Column) -> Column:
    """Token form of transcript QA: outer punctuation trimmed, lower case."""
    return F.lower(F.regexp_replace(word, "^[^A-Za-z0-9']+|[^A-Za-z0-9']+$", ""))


def alias_tokens(phrase: Column, stem_aliases: bool = False) -> Column:
    """Slash-separated aliases to arrays of reprice tokens.

    Transcript tokens are stemmed and aliases are not, so an inflected alias never matches;
    ``stem_aliases`` lifts that.
    """
    def tokens(alias: Column) -> Column:
        cleaned = F.transform(F.split(squeeze(alias), " "),
                              lambda w: stem(reprice_token(w)) if stem_aliases else reprice_token(w))
        return F.filter(cleaned, lambda t: t != "")

    return F.filter(F.transform(F.split(phrase, "/"), tokens), lambda ts: F.size(ts) > 0)


def surface_forms(phrase: Column, single: dict[str, list[str]] = SINGLE_VARIANTS,
                  plurals: dict[str, str] = LAST_WORD_PLURALS) -> Column:
    """Sorted distinct surface forms of a phrase: aliases, listed variants, plain plural."""
    listed = F.create_map(*[x for k, vs in single.items()
                            for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    none = F.array().cast("array<string>")

    def forms(alias: Column) -> Column:
        base = F.lower(alias)
        many = _lookup(plurals, base)
        own = F.try_element_at(listed, base)
        plain = F.when(own.isNull() & ~base.endswith("s"), F.array(F.concat(base, F.lit("s"))))
        one_word = F.when(~base.contains(" "), F.coalesce(own, plain))
        return F.concat(F.array(base), F.when(many.isNotNull(), F.array(many)).otherwise(none),
                        F.coalesce(one_word, none))

    aliases = F.transform(F.split(phrase, "/"), lambda a: F.trim(a))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(aliases, forms))))


def event_kind(title: Column) -> Column:
    """Event type hint from a series title, first keyword in list order."""
    name, out = F.lower(F.coalesce(title, F.lit(""))), None
    for kind in EVENT_KINDS:
        value = "presser" if "press" in kind else kind
        hit = name.contains(kind)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise("remarks")


def video_id(url: Column) -> Column:
    """Video id of a video URL, NULL when there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), VIDEO_ID, 1)
    return F.when(found != "", found)
