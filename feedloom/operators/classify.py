"""Classification by ordered rules: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators.filters import CATEGORIES

#: Fixed values: (category, needles) tried on section and categories, before and after the table of whole sections.
EARLY_RULES = (
    ("Crypto / Web3", ("crypto", "blockchain", "bitcoin", "web3", "ethereum")),
    ("Robotics", ("robot", "drone")),
    ("Fitness", ("fitness", "workout", "exercise", "sports science", "nutrition", "diet", "muscle", "strength training", "cardio", "endurance", "wellness")),
    ("Skincare", ("skincare", "skin care", "dermatolog", "sunscreen", "retinoid", "cosmetic", "beauty science", "acne")),
)
SECTIONS = {
    "artificial intelligence": "AI / ML", "security": "Security", "startups": "Startups & Funding", "fundraising": "Startups & Funding", "venture": "Startups & Funding",
    "fintech": "Startups & Funding", "space": "Science", "climate": "Science", "biotech health": "Science", "science": "Science", "hardware": "Hardware & Gadgets",
    "gadgets": "Hardware & Gadgets", "gear": "Hardware & Gadgets", "computex": "Hardware & Gadgets", "transportation": "Robotics", "cars": "Robotics",
}
LATE_RULES = (
    ("Coding & Dev Tools", ("open source", "developer", "programming", "devops", "kubernetes", "github", "software engineering")),
    ("Learning & Career", ("evergreen", "glossary", "explainer", "tutorial", "how-to", "how to", "career", "roadmap")),
    ("Security", ("cybersecurity", "security", "hacker", "breach", "privacy", "ransomware", "malware")),
    ("Science", ("space", "spacex", "climate", "biotech", "health", "energy", "quantum", "science")),
    ("Hardware & Gadgets", ("hardware", "gadget", "wearable", "laptop", "smartphone")),
    ("Startups & Funding", ("startup", "venture", "fundrais", "seed", "series ", "ipo", "acquisition", "fintech")),
    ("AI / ML", ("artificial intelligence", "machine learning", "openai", "anthropic", "llm", "chatbot", "genai", "ai agents", "xai", "gemini", " ai ")),
    ("Coding & Dev Tools", ("developer", "api", "sdk", "framework")),
)


def _first(rules: Sequence[tuple[str, Sequence[str]]], tokens: Column, otherwise: Column) -> Column:
    # A function of one argument: Spark would pass an index for a second one, default or not.
    def holds(needles: Sequence[str]) -> Column:
        return F.exists(tokens, lambda t: text.has_any(t, needles))

    out = otherwise
    for name, needles in reversed(list(rules)):
        out = F.when(holds(needles), name).otherwise(out)
    return out


def article_category(section: Column, categories: Column, region: Column, *, early=EARLY_RULES, sections=SECTIONS, late=LATE_RULES, labels=CATEGORIES, research="Science", default="Big Tech") -> Column:
    """An exact label among the categories, else the first rule that holds."""
    cats = F.coalesce(categories, F.array().cast("array<string>"))
    exact = F.get(F.filter(cats, lambda c: c.isin(*[full for full, _ in labels])), 0)
    own = F.lower(text.squashed(section))
    tokens = F.transform(F.concat(F.array(text.text_of(section)), cats), lambda t: F.lower(text.squashed(t)))
    table = F.create_map(*[x for k, v in sections.items() for x in (F.lit(k), F.lit(v))])
    rest = F.when(F.lower(text.squashed(region)) == "research", research).otherwise(default)
    return F.coalesce(exact, _first(early, tokens, F.coalesce(F.try_element_at(table, own), _first(late, tokens, rest))))


def first_pattern(haystack: Column, rules: Sequence[tuple[str, str]], default: Column | str) -> Column:
    """The name of the first pattern that the haystack holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for name, pattern in reversed(list(rules)):
        out = F.when(haystack.rlike(pattern), name).otherwise(out)
    return out


def tagged(section: Column, tags: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), F.lit(v))]), section), otherwise)


def client_category(categories: Column, section: Column, labels=CATEGORIES, default: str = "Big Tech") -> Column:
    """The first known category, else the section as a label, else the first category, else the default."""
    full = [a for a, _ in labels]
    short = F.create_map(*[x for a, b in labels for x in (F.lit(b.lower()), F.lit(a))])
    cats = F.coalesce(categories, F.array().cast("array<string>"))
    return F.coalesce(F.get(F.filter(cats, lambda c: c.isin(*full)), 0), F.try_element_at(short, F.lower(section)), F.get(cats, 0), F.lit(default))


#: Tags that decide, and patterns by which a paper's app category is found, in this order; each reads the
#: whole text of the record, or its title only.
PAPER_TAGS = {
    "fitness exercise": "Fitness", "skincare dermatology": "Skincare", "nutrition diet": "Science", "psychology mind": "Science", "longevity health": "Science", "science discovery": "Science",
    "finance investing": "Startups & Funding",
}
PAPER_RULES = (
    ("Robotics", "all", r"(^|[^a-z0-9_])robot|locomotion|quadruped|manipulation|(^|[^a-z0-9_])cs\.ro([^a-z0-9_]|$)"),
    ("Security", "all", r"secur|cryptograph|adversarial|malware|vulnerab|(^|[^a-z0-9_])cs\.cr([^a-z0-9_]|$)"),
    (
        "Science", "title",
        r"disease|clinical|patient|cancer|tumou?r|oncolog|epidemiolog|mortalit|metaboli|metabolom|cytometr|genom|protein|biomarker|therap|diagnos|vaccine|(^|[^a-z0-9_])cell([^a-z0-9_]|$)"
        r"|molecul|chemi|materials|cond-mat|(^|[^a-z0-9_])physics([^a-z0-9_]|$)|astro|(^|[^a-z0-9_])telescope([^a-z0-9_]|$)|interferometr|exoplanet|radial[- ]velocity|cosmolog|climate"
        r"|neurosci|q-bio|biolog|supercond|(^|[^a-z0-9_])quantum([^a-z0-9_]|$)",
    ),
    (
        "Coding & Dev Tools", "all",
        r"software engineering|programming language|compiler|(^|[^a-z0-9_])code([^a-z0-9_]|$)|developer|debug|(^|[^a-z0-9_])cs\.(se|pl)([^a-z0-9_]|$)|static analysis|software dev",
    ),
    (
        "Hardware & Gadgets", "all",
        r"semiconduct|(^|[^a-z0-9_])hardware([^a-z0-9_]|$)|fpga|circuit|photonic|(^|[^a-z0-9_])gpu([^a-z0-9_]|$)|accelerator|(^|[^a-z0-9_])(chip|asic|cs\.ar|eess)([^a-z0-9_]|$)|applied physics",
    ),
    ("Science", "all", r"supercond|materials|cond-mat|physics|biolog|chemi|astro|quantum|genom|protein|climate|neurosci|q-bio|biomolecul"),
    ("Startups & Funding", "all", r"venture|startup|fundrais|business model|q-fin|econ\.gn|market dynamics"),
)


def paper_category(section: Column, categories: Column, id: Column, title: Column, *, tags=PAPER_TAGS, rules=PAPER_RULES, default: str = "AI / ML") -> Column:
    """The category of a paper: its section's tag, else the first rule that holds."""
    cats = F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " ")
    hay = {"all": F.lower(F.concat_ws(" ", text.text_of(section), cats, text.text_of(id), text.text_of(title))), "title": F.lower(text.text_of(title))}
    out = F.lit(default)
    for name, where, pattern in reversed(rules):
        out = F.when(hay[where].rlike(pattern), name).otherwise(out)
    return tagged(section, tags, out)


#: Licences by the end of their address's path, their id, or a pattern of their name; the first that matches counts.
LICENCES = (
    ("CC0-1.0", r"/publicdomain/zero/1\.0/?$", r"(^|[^a-z0-9_])cc\s*0\s*(1\.0)?([^a-z0-9_]|$)"),
    ("PDM-1.0", r"/publicdomain/mark/1\.0/?$", r"(^|[^a-z0-9_])public\s+domain(\s+mark)?\s*(1\.0)?([^a-z0-9_]|$)"),
    ("CC-BY-4.0", r"/licenses/by/4\.0/?$", r"(^|[^a-z0-9_])cc\s*[- ]?by\s*4\.0([^a-z0-9_]|$)"),
    ("CC-BY-3.0", r"/licenses/by/3\.0/?$", r"(^|[^a-z0-9_])cc\s*[- ]?by\s*3\.0([^a-z0-9_]|$)"),
)
#: An address of the licences' public host, without port or credentials.
LICENCE_HOST = r"^https?://([a-z0-9-]+\.)*creativecommons\.org/"


def licence(value: Column, table=LICENCES) -> Column:
    """The id of a licence written as an address, as an id, or as text; null if it is none of these."""
    t = F.lower(F.trim(text.text_of(value)))
    path = F.regexp_replace(F.regexp_replace(t, "[?#].*$", ""), LICENCE_HOST, "/")
    pick = lambda test: F.coalesce(*[F.when(test(row), row[0]) for row in table])
    by_path = F.when(t.rlike(LICENCE_HOST), pick(lambda r: path.rlike(r[1])))
    return F.coalesce(by_path, pick(lambda r: t == r[0].lower()), pick(lambda r: t.rlike(r[2])))


def licence_address(value: Column, table=LICENCES) -> Column:
    """The id of a licence that must be written as an address."""
    return F.when(F.lower(F.trim(text.text_of(value))).rlike(LICENCE_HOST), licence(value, table))


def one_licence(values: Column, table=LICENCES) -> Column:
    """The licence of a document that states several addresses: only if there are some and every one resolves to the same."""
    found = F.transform(values, lambda v: licence_address(v, table))
    whole = (F.size(found) > 0) & F.forall(found, lambda x: x.isNotNull()) & (F.size(F.array_distinct(found)) == 1)
    return F.when(whole, F.get(found, 0))
