"""Column expressions over payload text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import constants as C


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when ``text`` holds one of the substrings; stays inside codegen."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def is_whitelisted(payload: Column) -> Column:
    return contains_any(payload, C.WHITELIST)


def is_ssh_attack(payload: Column) -> Column:
    return contains_any(payload, C.SSH_ATTACK_SIGNATURES)


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, f"[{C.BLANKS}]+", "") == ""


def is_garbage(line: Column) -> Column:
    """Header, ruler or blank line of a snapshot dump."""
    return contains_any(line, C.GARBAGE_MARKERS) | is_blank(line)


def resolved_ip(payload: Column, given: Column) -> Column:
    """The given address, or the first one found in the payload when it is unknown."""
    quad = F.regexp_extract(payload, C.DOTTED_QUAD, 0)
    rhost = F.translate(F.regexp_extract(payload, C.HYPHEN_RHOST, 1), "-", ".")
    known = (given != C.UNKNOWN_IP) & (given != "")
    return (
        F.when(known, given)
        .when(payload.rlike(C.DOTTED_QUAD), quad)
        .when(payload.rlike(C.HYPHEN_RHOST), rhost)
        .otherwise(given)
    )


def refined_layer(payload: Column, act: Column) -> Column:
    """Host layers are told apart by their text; Windows is tested first."""
    host = act.contains("HOST")
    return (
        F.when(host & contains_any(payload, C.WINDOWS_SIGNATURES), F.lit("HOST_WIN"))
        .when(host & contains_any(payload, C.LINUX_SIGNATURES), F.lit("HOST_LIN"))
        .otherwise(act)
    )


def model_of(tag: Column) -> Column:
    """Name of the model for a layer; null when no model is known.

    A map lookup names ``tag`` once: a chain of comparisons would copy the layer expression
    into every branch when a predicate is pushed below the projection.
    """
    pairs = [F.lit(x) for pair in C.MODEL_OF_TAG.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), tag)


def specialist_of(tag: Column) -> Column:
    """Long host names become the model's name; everything else stays."""
    return (
        F.when(tag == "HOST_LINUX", F.lit("HOST_LIN"))
        .when(tag == "HOST_WINDOWS", F.lit("HOST_WIN"))
        .otherwise(tag)
    )


def preview(payload: Column) -> Column:
    return F.substring(payload, 1, C.PREVIEW_CHARS)


def truth_label(payload: Column, act: Column, dataset: Column) -> Column:
    """1 for an attack, 0 for normal traffic."""
    attack_set = dataset.contains("DDos") | F.lower(dataset).contains("attack")
    return (
        F.when(act.contains(C.FLOW_TAG),
               F.when(F.upper(payload).contains("BENIGN"), 0).otherwise(1))
        .when(attack_set, 1)
        .when(contains_any(payload, C.TRUTH_SIGNATURES), 1)
        .otherwise(0)
    )
