"""Column functions over names, ingredients, titles and hashes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms and trade words that names are compared without.
LEGAL_SUFFIXES = (
    "ltd|limited|inc|incorporated|llc|llp|plc|gmbh|ag|bv|nv|sa|sas|spa|kk|pty|"
    "pharmaceuticals?|pharma|pvt|private|co|company|corp|corporation|"
    "industries?|group|holdings?|international|intl|mfg|manufacturing"
)
# Fixed value: corporate forms written with dots.
DOTTED_FORMS = r"[sn]\.?[av]\.?|b\.?v\.?|p\.?l\.?c\.?|g\.?m\.?b\.?h\.?"

# Salt and hydrate words at the end of an ingredient, in order of precedence.
SALT_SUFFIXES = (
    "hydrochloride", "dihydrochloride", "monohydrochloride", "sesquihydrate", "monohydrate", "dihydrate", "anhydrous", "hcl",
    "sodium", "disodium", "trisodium", "potassium", "calcium", "magnesium", "zinc", "aluminum", "aluminium", "ammonium",
    "sulfate", "sulphate", "bisulfate", "disulfate", "phosphate", "diphosphate", "citrate", "acetate", "diacetate",
    "succinate", "hemisuccinate", "tartrate", "bitartrate", "hemitartrate", "maleate", "fumarate", "hemifumarate",
    "mesylate", "mesilate", "tosylate", "benzoate", "valerate", "stearate", "palmitate", "propionate", "gluconate",
    "lactate", "oxalate", "bromide", "iodide", "fluoride", "nitrate", "nitrite", "carbonate", "bicarbonate",
)

# Words that are no ingredient when they stand alone.
INGREDIENT_STOPWORDS = ("and", "or", "with", "in", "of", "the", "a", "an", "to", "for")
# Countries recognised at the end of a manufacturer cell.
KNOWN_COUNTRIES = (
    "kenya", "uganda", "tanzania", "ethiopia", "rwanda", "burundi", "somalia", "south sudan", "nigeria", "ghana",
    "south africa", "zambia", "zimbabwe", "malawi", "mozambique", "india", "china",
)
# The two alias pairs of ingredient names that are known; extend by parameter.
INN_ALIASES = {"paracetamol": "acetaminophen", "amoxycillin": "amoxicillin"}


def squeeze(col: Column) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", " "), "^ | $", "")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def fold_accents(col: Column) -> Column:
    """Compatibility decomposition without combining marks, for all characters of the scripts that names are written in.

    One-to-one decompositions are one translation; longer ones (ligatures, fractions, signs of several letters) are replaced
    where a text has any.
    """
    source, target, longer = [], [], {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2190), *range(0x2460, 0x2500), *range(0x3200, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
        elif len(plain) > 1:
            longer[chr(code)] = plain
    text = F.translate(F.regexp_replace(col, r"\p{M}", ""), "".join(source), "".join(target))
    table = F.create_map(*[F.lit(x) for kv in longer.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    folded = F.when(text.rlike("[" + "".join(longer) + "]"), spelled).otherwise(text)
    return F.when(col.rlike(r"[^\x00-\x7F]"), folded).otherwise(col)  # ASCII needs none of it


def normalize_name(col: Column) -> Column:
    """The key under which manufacturer names are compared: case, accents, punctuation and legal forms gone."""
    text = F.lower(fold_accents(col))
    text = F.regexp_replace(text, rf"(?U)\b({DOTTED_FORMS})\b\.?", " ")
    text = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    return squeeze(F.regexp_replace(text, rf"(?U)\b({LEGAL_SUFFIXES})\b", " "))


def normalize_ingredient(col: Column) -> Column:
    """Lower case, single spaces, and one trailing salt word less; the word must follow a space."""
    return F.regexp_replace(squeeze(F.lower(col)), rf" ({'|'.join(SALT_SUFFIXES)})$", "")


def normalize_inn(col: Column, aliases: dict[str, str] | None = None) -> Column:
    """The alias table's name for an ingredient, else the trimmed input."""
    table = INN_ALIASES if aliases is None else aliases
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    trimmed = strip(col)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(trimmed)), trimmed) if pairs else trimmed


def normalize_inn_list(col: Column, aliases: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(normalized, raw) lists without blanks."""
    raw = F.filter(F.transform(col, strip), lambda x: x != "")
    return F.transform(raw, lambda x: normalize_inn(x, aliases)), raw


def parse_ingredient_cell(col: Column, aliases: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(normalized, raw) ingredients of a cell: parts by line or semicolon, strengths cut off, lone stopwords dropped."""
    bare = lambda x: strip(F.regexp_replace(x, r"(?iU)\s+\d[\d.,]*\s*(?:mg|mcg|µg|ug|g|ml|iu|units?)\b.*$", ""))
    raw = F.filter(F.transform(F.split(col, "[\n;]"), strip), lambda x: (x != "") & ~F.lower(bare(x)).isin(*INGREDIENT_STOPWORDS))
    return F.transform(raw, lambda x: normalize_inn(F.when(bare(x) != "", bare(x)).otherwise(x), aliases)), raw


def infer_severity(col: Column, missing: str | None = "unclassified") -> Column:
    """class_1, class_2 or class_3 from "class I/II/III/1/2/3" anywhere in the text."""
    found = F.lower(F.regexp_extract(col, r"(?i)\bclass\s+(i{1,3}|[123])\b", 1))
    return F.when(found.isin("i", "1"), "class_1").when(found.isin("ii", "2"), "class_2").when(found.isin("iii", "3"), "class_3").otherwise(F.lit(missing))


def map_severity(col: Column) -> Column:
    """Exact "Class I/II/III", blanks at the ends aside; null for nothing, unclassified for anything else."""
    said = strip(col)
    return (
        F.when(col.isNull() | (col == ""), F.lit(None)).when(said == "Class I", "class_1").when(said == "Class II", "class_2")
        .when(said == "Class III", "class_3").otherwise("unclassified")
    )


def split_list(col: Column, by: str = ";") -> Column:
    """Trimmed parts that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), by), strip), lambda x: x != "")


def parse_title(col: Column) -> tuple[Column, Column]:
    """("Name", [A, B]) of "Name (A, B)"; the whole title and [] without parentheses at the end."""
    whole = strip(col)
    inner = F.regexp_extract(whole, r"^(.+?)\s*\(([^)]+)\)\s*$", 2)
    name = strip(F.regexp_extract(whole, r"^(.+?)\s*\(([^)]+)\)\s*$", 1))
    return F.when(inner != "", name).otherwise(whole), F.when(inner != "", split_list(inner, ",")).otherwise(F.array().cast("array<string>"))


def trailing_country(col: Column) -> Column:
    """[country] if the text after the last comma is a known one, else []."""
    last = strip(F.element_at(F.split(col, ","), -1))
    return F.when(F.contains(col, F.lit(",")) & F.lower(last).isin(*KNOWN_COUNTRIES), F.array(last)).otherwise(F.array().cast("array<string>"))


def source_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a separator; missing parts are empty, lists are sorted."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def sorted_list(col: Column) -> Column:
    return F.array_join(F.sort_array(F.coalesce(col, F.array().cast("array<string>"))), ",")


def canonical_json(col: Column, kind: T.DataType) -> Column:
    """JSON with the keys in order, whatever form the metadata has: a map, a struct, a variant or JSON text. Missing metadata is ``{}``."""

    def ordered(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)])
        if isinstance(t, T.MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda _, v: ordered(v, t.valueType)))))
        return F.transform(c, lambda x: ordered(x, t.elementType)) if isinstance(t, T.ArrayType) else c

    keep = {"ignoreNullFields": "false"}
    if isinstance(kind, T.StringType):
        made = F.coalesce(F.to_json(F.try_parse_json(col)), col)
    else:
        made = F.when(col.isNotNull(), F.to_json(ordered(col, kind), keep))
    return F.coalesce(made, F.lit("{}"))


def document_hash(schema: T.StructType) -> Column:
    """Content hash of a normalized document of this schema: address, number, title, lists, class, dates and metadata. Raw text and times don't count, the order of lists doesn't."""
    have = {f.name: f.dataType for f in schema.fields}
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    items = lambda n: sorted_list(F.col(n)) if n in have else F.lit("")
    metadata = canonical_json(F.col("raw_metadata"), have["raw_metadata"]) if "raw_metadata" in have else F.lit("{}")
    parts = [c("source_id"), c("source_url"), c("document_id"), c("title"), items("product_names"), items("active_ingredients"), items("manufacturers"), c("severity"), c("date_published"), c("date_effective")]
    return content_hash(*parts, metadata)


def safe_name(url: Column, number: Column | None = None, prefix: str = "doc_") -> Column:
    """The PDF's file name in the URL's path, else a name from the number or from the URL's hash."""
    base = F.element_at(F.split(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/"), -1)
    own = F.lower(base).rlike(r"\.pdf$") & ~F.startswith(F.lower(base), F.lit("download"))
    by_hash = F.substring(F.md5(url), 1, 8)
    return F.when(own, base).otherwise(F.concat(F.lit(prefix), by_hash if number is None else F.coalesce(number.cast("string"), by_hash), F.lit(".pdf")))
