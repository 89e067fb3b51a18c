"""Identity grammars as Column expressions: node ids, link bodies, selectors, decision ids, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node id prefixes.
PREFIXES = ["note", "code", "symbol", "pattern", "import", "external-call", "external-module", "dynamic-call"]


def trimmed(x: Column) -> Column:
    """x without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def slug(x: Column) -> Column:
    """Letters and digits of any script in lower case, other runs as one dash between them."""
    return F.array_join(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""), "-")


def node_prefix(x: Column) -> Column:
    """What stands before the first colon."""
    return F.when(F.instr(x, ":") > 0, F.substring_index(x, ":", 1))


def node_body(x: Column) -> Column:
    """What stands after the first colon."""
    return F.when(F.instr(x, ":") > 0, F.regexp_replace(x, r"(?s)^[^:]*:", ""))


def node_id(prefix: str, body: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), body)


def heading_id(note: Column, heading: Column) -> Column:
    return F.concat(F.lit("note:"), note, F.lit("#"), slug(heading))


def directive_id(path: Column, kind: Column, module: Column, site: Column) -> Column:
    return F.concat_ws(":", F.lit("import"), path, kind, module, site.cast("string"))


def edge_text(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws(":", src, kind, dst)


def link_body(raw: Column) -> Column:
    """A link without its alias."""
    return trimmed(F.substring_index(raw, "|", 1))


def link_alias(raw: Column) -> Column:
    return F.when(F.instr(raw, "|") > 0, trimmed(F.regexp_replace(raw, r"(?s)^[^|]*\|", "")))


def link_target(raw: Column) -> Column:
    """A link's target without fragment and alias."""
    return trimmed(F.substring_index(link_body(raw), "#", 1))


def link_fragment(raw: Column) -> Column:
    """What stands after the first # of a link's body; null if nothing does."""
    body = link_body(raw)
    return F.when(F.instr(body, "#") > 0, F.nullif(trimmed(F.regexp_replace(body, r"(?s)^[^#]*#", "")), F.lit("")))


def is_line_fragment(fragment: Column) -> Column:
    """L and a positive number, maybe a second after -L."""
    return fragment.rlike(r"^L\+?0*[1-9][0-9]*(-L\+?0*[1-9][0-9]*)?$")


def parent_dir(path: Column) -> Column:
    """The directory of a path, a dot for none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def safe_path(raw: Column) -> Column:
    """A relative path with plain separators; null where it is absolute, has a drive, climbs up, or is empty."""
    x = F.replace(trimmed(raw), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    bad = x.startswith("/") | x.rlike(r"^[A-Za-z]:") | (F.instr(x, "\u0000") > 0) | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def is_hash(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def civil_date(x: Column) -> Column:
    """Whether yyyyMMdd is a day of the calendar."""
    return x.rlike("^[0-9]{8}$") & (F.date_format(F.try_to_timestamp(x, F.lit("yyyyMMdd")), "yyyyMMdd") == x)


def day_text(epoch_day: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), epoch_day), "yyyyMMdd")


def decision_number(x: Column) -> Column:
    return F.regexp_extract(x, r"^ADR-([0-9]{4})$", 1)


def is_decision_id(x: Column) -> Column:
    """ADR-NNNN, or ADR-yyyyMMdd-slug with a day of the calendar."""
    dated = F.regexp_extract(x, r"^ADR-([0-9]{8})-[a-z0-9]+(?:-[a-z0-9]+)*$", 1)
    return (decision_number(x) != "") | ((dated != "") & F.coalesce(civil_date(dated), F.lit(False)))


def decision_file_ok(id_: Column, path: Column) -> Column:
    """Whether a decision's file is named after its id, maybe with a slug after a numbered one."""
    low, name = F.lower(F.regexp_replace(id_, "^ADR-", "")), F.lower(stem(path))
    return (name == low) | (name == F.lower(id_)) | name.startswith(F.concat(low, F.lit("-")))


def pattern_decision(x: Column) -> Column:
    return F.when(F.instr(x, "/") > 0, F.substring_index(x, "/", 1))


def pattern_local(x: Column) -> Column:
    return F.when(F.instr(x, "/") > 0, trimmed(F.regexp_replace(x, r"(?s)^[^/]*/", "")))


def percent_encoded(x: Column) -> Column:
    """Unreserved ASCII as it is, every other byte as % and two digits."""
    return F.array_join(
        F.transform(F.split(x, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9._~-]?$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), ""
    )


def percent_decoded(x: Column) -> Column:
    """The text of a percent-encoded value; null if it is malformed."""
    ok = ~x.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(ok, F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))


def callable_selector(module: Column, kind: Column, name: Column, arity: Column) -> Column:
    return F.concat(F.lit("module:"), percent_encoded(module), F.lit("/"), kind, F.lit(":"), percent_encoded(name), F.lit("/"), arity.cast("string"))


def selector_parts(x: Column) -> Column:
    """Struct (module, kind, name, arity) of a callable's selector; null fields where it is none."""
    at = r"^module:([^/]+)(?:/([a-z-]+):([^/]+)/(0|[1-9][0-9]*))?$"
    part = lambda k: F.nullif(F.regexp_extract(x, at, k), F.lit(""))
    return F.struct(percent_decoded(part(1)).alias("module"), part(2).alias("kind"), percent_decoded(part(3)).alias("name"), part(4).cast("long").alias("arity"))


def aliases(name: Column, arity: Column, module: Column) -> Column:
    """Older ways to write a callable: name, name/arity, Module.name/arity."""
    with_arity = F.concat(name, F.lit("/"), arity.cast("string"))
    return F.array_distinct(F.filter(F.array(name, with_arity, F.concat(module, F.lit("."), with_arity)), lambda x: x.isNotNull()))


def symbol_selector(kind: Column, name: Column, parent: Column) -> Column:
    """Selector of a symbol by its kind and parent type."""
    return (
        F.when(kind == "function", F.concat(F.lit("fn:"), name))
        .when((kind == "method") & parent.isNotNull(), F.concat(F.lit("type:"), parent, F.lit("/member:"), name))
        .when(kind == "method", F.concat(F.lit("member:"), name))
        .when(kind.isin("class", "struct", "type"), F.concat(F.lit("type:"), name))
        .otherwise(F.concat(kind, F.lit(":"), name))
    )


def is_file_backed(path: Column, link: Column) -> Column:
    """X26. Whether a link's path names a note's file: its stem, or its path with or without the extension, whatever the case."""
    key, low = F.lower(link), F.lower(path)
    return (F.lower(stem(path)) == key) | (low == key) | (F.regexp_replace(low, r"\.md$", "") == key) & low.endswith(".md")


def portable_target(path: Column, link: Column) -> Column:
    """X26. A link written with the stem of a note's file, its own text as alias unless it is that already."""
    fragment = link_fragment(link)
    own = F.concat(stem(path), F.when(fragment.isNotNull(), F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    return F.when(own == link, own).otherwise(F.concat(own, F.lit("|"), link))
