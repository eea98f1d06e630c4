"""RDF terms as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the RDF vocabulary and of the node names that stand for whole classes of terms.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
LIST_TERMS = [RDF + "first", RDF + "rest", RDF + "nil", RDF + "List"]
LITERAL_NODE = "_:literalNode"
TYPE_NODE = "_:rdfTypeNode"

_IRI = r"<(?:[^>]|>(?![ \t]))*>"
_BLANK = r"_:\S+"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+)?(?:\^\^<[^>]*>)?'
#: Subject, predicate, object, and whatever stands before the final dot (a graph name).
TRIPLE = rf"^\s*({_IRI}|{_BLANK})\s+({_IRI})\s+({_IRI}|{_BLANK}|{_LITERAL})\s*((?:<[^>]*>|_:\S+)?)\s*\.\s*$"


def kind(term: Column) -> Column:
    """``iri``, ``blank`` or ``literal``; null for anything else."""
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "blank").when(term.startswith('"'), "literal")


def stripped(term: Column) -> Column:
    """The inside of an IRI's brackets; blank nodes keep ``_:`` in every position; literals stay."""
    return F.when(term.startswith("<"), F.substr(term, F.lit(2), F.length(term) - 2)).otherwise(term)


def is_list_term(term: Column) -> Column:
    return term.isin(LIST_TERMS)


def percent_encoded(text: Column) -> Column:
    """Percent-encodes all bytes but unreserved ones and ``:/?#[]@!$&'()*+,;=``."""
    spaced = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    out = F.replace(spaced, F.lit("%7E"), F.lit("~"))
    for c in ":/?#[]@!$&'()*+,;=":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def block_iri(members: Column, how: str) -> Column:
    """A block's name from the array of its members (ids for ``id_set``, IRIs for the others)."""
    ordered = F.array_join(F.transform(F.sort_array(members), lambda m: m.cast("string")), ",")
    if how == "id_set":
        return F.concat(F.lit("id_block-"), ordered)
    if how == "iri_set":
        return F.concat(F.lit("iri_block-"), ordered)
    if how == "hash":
        return F.concat(F.lit("hash_block-"), F.base64(F.unhex(F.sha2(F.encode(ordered, "UTF-8"), 256))))
    raise ValueError(f"unknown kind of block name: {how}")


def member_digest(member: Column, part: int) -> Column:
    """BIGINT: the ``part``-th (0 to 3) 32 bits of a member's MD5; sums of them tell sets of members apart."""
    return F.conv(F.substring(F.md5(F.encode(member.cast("string"), "UTF-8")), 8 * part + 1, 8), 16, 10).cast("bigint")


def level_name(level: Column, width: int = 4) -> Column:
    """A level's number with leading zeros, as in names of files."""
    return F.lpad(level.cast("string"), width, "0")


def singleton_id(node: Column) -> Column:
    """The id of a block of one node, and its own inverse."""
    return -node - 1


def clip_start(s_start: Column, o_start: Column) -> Column:
    """First level of a data edge: its subject's block is one level above its object's."""
    return F.greatest(s_start, o_start + 1)


def clip_end(s_end: Column, o_end: Column, last: Column) -> Column:
    """Last level of a data edge; ``last + 1`` where both blocks live for ever."""
    return F.when((s_end == last) & (o_end == last), last + 1).otherwise(F.least(s_end, o_end + 1))
