"""Text column builders: cleaning, ad status, contacts, links, categories."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlens.constants import CATEGORIES

# Words that are never channel names
STOP_NAMES = """
addstickers share proxy joinchat stickerpack
s c iv msg vote boost premium emoji
fetchall fetchone fetchmany execute commit cursor
pytest unittest numpy pandas scipy matplotlib
torch keras flask django fastapi requests
asyncio aiohttp httpx redis celery sqlalchemy
react redux vuejs angular nextjs nodejs
webpack eslint prettier typescript javascript
async await import export const class state
return function lambda yield static public
private protected interface abstract override
binding observable subscribe dispatch middleware
environment production development staging testing
config settings options params arguments
google github gitlab bitbucket stackoverflow
youtube twitter instagram facebook linkedin
discord slack medium notion figma linux
python kotlin swift rustlang golang clojure
haskell elixir erlang scala groovy
admin support helper utils tools service
handler controller model schema migration
dockerfile makefile readme changelog license
tetrad string array object integer boolean
""".split()

# Wording that refuses, sells, or offers contact about advertising
REFUSAL = [
    r"без\s+рекламы", r"нет\s+рекламы", r"рекламу\s+не\s+(публикую|размещаю|беру|принимаю|продаю)",
    r"не\s+размещаю?\s+реклам", r"no\s+ads", r"ads?\s+free", r"ad-free", r"рекламы\s+нет", r"без\s+вп",
]
EXPLICIT = [
    r"реклам[аы]", r"рекламн", r"сотрудничеств", r"размещени", r"партн[её]рств", r"прайс", r"по вопросам рекламы",
    r"реклама\s*[:@]", r"@\w+.*реклама", r"реклама.*@\w+", r"покупк[аи]\s+рекламы", r"заказать?\s+рекламу", r"менеджер",
    r"\bpr\b", r"пиар\b", r"\bprice\b", r"\brates\b", r"for\s+ads", r"advertising", r"ad\s+placement", r"sponsored\s+posts?",
    r"paid\s+promotion", r"\bpromo\b", r"\bcommercial\b", r"\bbooking\b", r"\bcollab\b", r"\bpartnership\b",
]
CONTACT = [
    r"@[a-zA-Z]\w{3,}", r"t\.me/[a-zA-Z]\w+", r"telegram\.me/\w+", r"связь", r"контакт", r"contact", r"написать",
    r"обращаться", r"пишите", r"напишите", r"write\s+to", r"dm\s+for", r"message\s+us", r"предложени", r"по вопросам",
    r"\bвп\b", r"взаимн", r"кросс-промо", r"\bmutual\b",
]
AD_KEYWORDS = ["реклама", "pr", "сотрудничество", "менеджер", "размещение", "прайс", "продвижение", "партнер", "реклам"]

# Keywords of a channel type, in the order in which ties are decided
TYPE_KEYWORDS = {
    "TECH": ["python", "javascript", "код", "программ", "dev", "api", "github", "npm", "docker", "react", "vue", "backend",
             "frontend", "llm", "ml", "ai", "нейросет", "модел", "gpt", "ollama", "gguf"],
    "CRYPTO": ["btc", "eth", "крипт", "токен", "defi", "nft", "блокчейн", "биткоин", "эфир", "coin", "swap", "airdrop", "wallet"],
    "NEWS": ["новости", "news", "срочно", "breaking", "политик", "экономик", "инфляц", "курс валют"],
    "ENTERTAINMENT": ["мем", "юмор", "прикол", "смешн", "фильм", "сериал", "игр", "anime", "аниме", "музык"],
    "BUSINESS": ["бизнес", "стартап", "предприним", "маркетинг", "продаж", "финанс", "инвестиц", "акци"],
}
TYPE_OF_CATEGORY = {
    "TECH": "TECH", "AI_ML": "TECH", "EDUCATION": "TECH", "CRYPTO": "CRYPTO", "NEWS": "NEWS",
    "ENTERTAINMENT": "ENTERTAINMENT", "LIFESTYLE": "ENTERTAINMENT",
    "BUSINESS": "BUSINESS", "FINANCE": "BUSINESS", "REAL_ESTATE": "BUSINESS",
}

FACES = "[\\x{1F600}-\\x{1F64F}]{3,}"
SYMBOLS = "[\\x{1F300}-\\x{1F5FF}]{3,}"


# Characters that count as white space at the ends of a text
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column, symbols: bool = False) -> Column:
    """Without links and emoji runs, with at most one empty line in a row, trimmed.

    A pattern only runs on texts in which a byte search finds its fixed part.
    """
    def drop(value: Column, pattern: str, needed: Column, replacement: str = "") -> Column:
        return F.when(needed, F.regexp_replace(value, pattern, replacement)).otherwise(value)

    text = F.coalesce(text, F.lit(""))
    # a removed link always ends at a blank, so it never joins emoji; whatever is removed may join line breaks
    linked = text.contains("http") | text.contains("t.me/")
    emoji = text.rlike(f"{FACES}|{SYMBOLS}" if symbols else FACES)
    out = drop(text, r"(?U)https?://\S+", text.contains("http"))
    out = drop(out, r"(?U)t\.me/\S+", text.contains("t.me/"))
    out = drop(out, FACES, emoji)
    if symbols:
        # dropping faces may join symbols
        out = drop(out, SYMBOLS, text.rlike(r"[\x{1F300}-\x{1F5FF}]"))
    breaks = text.contains("\n\n\n") | linked | emoji
    return strip(drop(out, r"\n{3,}", breaks, "\n\n"))


def any_of(patterns: list[str]) -> str:
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def ad_status(description: Column) -> Column:
    """0 refuses or says nothing, 1 offers a contact, 2 sells advertising."""
    text = F.lower(description)
    return (
        F.when(description.isNull() | (description == ""), 0).when(text.rlike(any_of(REFUSAL)), 0)
        .when(text.rlike(any_of(EXPLICIT)), 2).when(text.rlike(any_of(CONTACT)), 1).otherwise(0)
    )


def ad_status_label(status: Column) -> Column:
    return F.when(status == 2, "sells").when(status == 1, "possible").when(status == 0, "closed").otherwise("unknown")


def _located(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their offsets, from the lengths of what lies between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def lengths(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))

    return F.transform(
        matches,
        lambda m, i: F.struct(
            m.alias("match"), (lengths(F.slice(between, F.lit(1), i + 1)) + lengths(F.slice(matches, F.lit(1), i))).alias("offset")
        ),
    )


def ad_contacts(description: Column, own_name: Column) -> Column:
    """Contacts in a description, first occurrence of each name, mentions before links."""
    keyword = "|".join(AD_KEYWORDS)
    own = F.coalesce(F.lower(F.regexp_replace(own_name, "^@+", "")), F.lit(""))

    def entries(pattern: str, name_pattern: str, prefix: str, kind: str, near: int, far: int) -> Column:
        def entry(hit: Column) -> Column:
            name = F.lower(F.regexp_extract(hit["match"], name_pattern, 1))
            start = F.greatest(F.lit(0), hit["offset"] - 50)
            stop = hit["offset"] + F.length(hit["match"]) + 50
            context = F.lower(F.substring(description, start + 1, stop - start))
            return F.struct(
                name.alias("name"), F.concat(F.lit(prefix), name).alias("contact"),
                F.when(name.endswith("bot"), "bot").otherwise(kind).alias("type"),
                F.when(context.rlike(keyword), near).otherwise(far).alias("confidence"),
            )

        return F.transform(_located(description, pattern), entry)

    name = "([a-zA-Z][a-zA-Z0-9_]{3,31})"
    found = F.concat(
        entries(f"@{name}", f"@{name}", "@", "telegram", 80, 30),
        entries(rf"(?i)t(?:elegram)?\.me/{name}", rf"/{name}", "t.me/", "telegram_link", 70, 25),
    )
    others = F.filter(found, lambda c: c["name"] != own)
    return F.filter(
        others, lambda c, i: ~F.exists(F.slice(others, F.lit(1), i), lambda earlier: earlier["name"] == c["name"])
    )


def linked_names(text: Column, own_name: Column | None = None) -> Column:
    """Channel names linked or mentioned in a text, without the own name, stop names and mentioned bots."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def found(pattern: str) -> Column:
        names = F.filter(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda n: ~n.isin(STOP_NAMES))
        return names if own_name is None else F.filter(names, lambda n: n != F.lower(own_name))

    mentions = F.filter(found("@([a-zA-Z0-9_]{5,32})"), lambda n: ~n.endswith("bot"))
    links = F.array_union(found(r"t\.me/([a-zA-Z0-9_]{5,32})"), found(r"telegram\.me/([a-zA-Z0-9_]{5,32})"))
    return F.array_union(links, mentions)


def answer_category(answer: Column) -> Column:
    """Category named in a model answer: tag, label, last valid word, any mention, in this order."""
    upper = F.upper(answer)
    tag = F.regexp_extract(upper, r"<CATEGORY>\s*([A-Z_]+)\s*</CATEGORY>", 1)
    label = F.regexp_extract(upper, r"CATEGORY[:\s]+([A-Z_]+)", 1)
    words = F.filter(F.regexp_extract_all(upper, F.lit(r"(?U)\b([A-Z_]+)\b"), F.lit(1)), lambda w: w.isin(CATEGORIES))
    mention = F.lit(None).cast("string")
    for name in reversed(CATEGORIES):
        mention = F.when(upper.contains(name), name).otherwise(mention)
    return F.coalesce(
        F.when(tag.isin(CATEGORIES), tag), F.when(label.isin(CATEGORIES), label), F.get(F.reverse(words), F.lit(0)), mention
    )


def split_category(answer: Column) -> dict[str, Column]:
    parts = F.split(answer, r"\+")
    return {"category": strip(F.get(parts, F.lit(0))), "category_secondary": strip(F.get(parts, F.lit(1)))}


def tidy_summary(text: Column) -> Column:
    """One-line summary without quotes and markup, at most 400 characters; NULL when shorter than 50."""
    out = strip(text)
    out = F.regexp_replace(out, '^"', "")
    out = F.regexp_replace(out, '"$', "")
    out = F.regexp_replace(out, r"\*", "")
    out = strip(F.regexp_replace(out, r"(?U)\s+", " "))
    head = F.substring(out, 1, 400)
    last = F.length(head) - F.instr(F.reverse(head), ".")
    cut = F.when(head.contains(".") & (last > 200), F.substring(head, F.lit(1), last + 1)).otherwise(head)
    return F.when(F.length(out) < 50, F.lit(None)).when(F.length(out) > 400, cut).otherwise(out)


def keyword_mask(text: Column) -> Column:
    """Bit set of the type keywords that a text contains, one bit per keyword.

    Keywords are searched as bytes. Those that begin with a byte beyond ASCII are only searched where one of their first bytes stands at all.
    """
    low = F.lower(text).cast("binary")
    plain, other = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    words = [word.encode() for listed in TYPE_KEYWORDS.values() for word in listed]
    for position, word in enumerate(words):
        bit = F.when(low.contains(F.lit(word)), F.lit(1 << position)).otherwise(F.lit(0)).cast("bigint")
        plain, other = (plain + bit, other) if word[0] < 128 else (plain, other + bit)
    firsts = [low.contains(F.lit(bytes([first]))) for first in sorted({word[0] for word in words if word[0] >= 128})]
    return plain + F.when(reduce(or_, firsts), other).otherwise(F.lit(0).cast("bigint"))


def type_masks() -> dict[str, int]:
    out, position = {}, 0
    for name, words in TYPE_KEYWORDS.items():
        out[name] = ((1 << len(words)) - 1) << position
        position += len(words)
    return out
