"""License recognition by sentences, with DataFrame functions only.

A text is cut into sentences, at closing marks and blank lines (lines without a
letter or digit); wrapped lines are joined, lines with an SPDX tag stand alone.
Each sentence is normalised (lower case, letters and digits, single blanks) and
mapped to the identifiers of all license sentences it holds, in their order.  The
identifiers of a text, in order, are then matched against ordered license rules;
a rule consumes what it matches and nothing that stands between, so that a longer
license goes before one whose sentences it contains.  A GPL without a version
adds nothing where one with a version is found.

Texts without a cue never reach the sentence step.  All of it is one projection
over the scan.

The SQL twin knows less: a line break ends its sentences, a sentence has one
identifier, and rules consume what stands between.  Both agree where a notice
is one sentence of one line, as in the test tables.

Defined cases: a null, empty or cue-less text has no sentences and no licenses;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUES = ("licen", "copyright", "permission", "redistribut", "warrant", "spdx", "rights reserved")
#: What a sentence of the SQL twin must hold to be mapped at all.
NEAR = (*CUES, "cc by", "cc-by", "cc0", "the above", "neither the name", "as is", "version", "rights reserved")
#: Sentence rules: identifier and pattern of the normalised sentence.  In the SQL twin the first that matches names the sentence.
SENTENCES = (
    ("spdx_mit", r"^spdx license identifier mit$"),
    ("spdx_apache2", r"^spdx license identifier apache 2 0$"),
    ("spdx_gpl3", r"^spdx license identifier gpl 3 0( only| or later)?$"),
    ("spdx_bsd3", r"^spdx license identifier bsd 3 clause$"),
    ("apache2", r"licensed under the apache license version 2( 0)?"),
    ("apache2_copy", r"you may obtain a copy of the license at"),
    ("apache2_basis", r"distributed under the license is distributed on an as is basis"),
    ("lgpl", r"gnu (lesser|library) general public license"),
    ("agpl3", r"gnu affero general public license"),
    ("gpl_any", r"either version (2|3) of the license or at your option any later version"),
    ("gpl3", r"gnu general public license( version)? 3"),
    ("gpl2", r"gnu general public license( version)? 2"),
    ("gpl", r"gnu general public license"),
    ("mpl2", r"mozilla public license v(ersion)? ?2"),
    ("cc_by_nc_sa", r"cc by nc sa( \d 0)?"),
    ("cc_by_nc_nd", r"cc by nc nd( \d 0)?"),
    ("cc_by_nc", r"cc by nc( \d 0)?"),
    ("cc_by_sa", r"cc by sa( \d 0)?"),
    ("cc_by", r"cc by( \d 0)?"),
    ("cc0", r"\bcc0\b"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"neither the name of .* nor the names of its contributors may be used to endorse"),
    ("as_is", r"(the|this) software is provided( by .*)? as is"),
    ("mit", r"(released|licensed|distributed) under the( terms of the)? mit license"),
    ("bsd", r"(released|licensed|distributed) under the( terms of the)? bsd license"),
    ("reserved", r"all rights reserved"),
)
#: License rules in order: license and the sequence of identifiers it asks for (others may stand between).
LICENSES = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache2", "apache2_copy", "apache2_basis")),
    ("GPL-3.0-or-later", ("gpl", "gpl_any")),
    ("Apache-2.0", ("apache2",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("MIT", ("mit",)),
    ("MIT", ("spdx_mit",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("AGPL-3.0", ("agpl3",)),
    ("LGPL", ("lgpl",)),
    ("GPL-3.0", ("gpl3",)),
    ("GPL-2.0", ("gpl2",)),
    ("GPL", ("gpl",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-NC-SA", ("cc_by_nc_sa",)),
    ("CC-BY-NC-ND", ("cc_by_nc_nd",)),
    ("CC-BY-NC", ("cc_by_nc",)),
    ("CC-BY-SA", ("cc_by_sa",)),
    ("CC-BY", ("cc_by",)),
    ("CC0", ("cc0",)),
    ("BSD", ("bsd",)),
)

#: What a text, and a sentence, must hold to be mapped at all: each sentence rule asks for one of these.
CUE = r"licen|copyright|permission|redistribut|warrant|spdx|rights[^a-z0-9]+reserved|cc[^a-z0-9]+by|cc0|neither[^a-z0-9]+the[^a-z0-9]+name|as[^a-z0-9]+is"
#: Sentence rules that differ where a sentence has all its identifiers: those that another one contains leave it out.
_GPL = r"gnu general public license( version)? v?"
_LATER = r"either version {0}( 0)? of the license or at your option any later version|" + _GPL + r"{0}( 0)? or( at your option any)? later"
_REPLACED = {
    "gpl3": _GPL + r"3\b",
    "gpl2": _GPL + r"2\b",
    "gpl": r"gnu general public license(?!( version)? v?[23]\b)",
    "cc_by_nc_sa": r"\bcc by nc sa\b",
    "cc_by_nc_nd": r"\bcc by nc nd\b",
    "cc_by_nc": r"\bcc by nc\b(?! (sa|nd)\b)",
    "cc_by_sa": r"\bcc by sa\b",
    "cc_by": r"\bcc by\b(?! (nc|sa)\b)",
    "isc_grant": r"permission to use copy modify and( or)? distribute this software for any purpose",
    "mit_notice": r"the above copyright notice and this permission notice( including the next paragraph)? shall be included",
}
PATTERNS = (
    *((name, _REPLACED.get(name, p)) for name, p in SENTENCES if name != "gpl_any"),
    ("gpl3_any", _LATER.format(3)),
    ("gpl2_any", _LATER.format(2)),
)
#: Rules by version in the place of the one that knows no version.
_OR_LATER = tuple((f"GPL-{v}.0-or-later", (first, f"gpl{v}_any")) for v in (3, 2) for first in (f"gpl{v}", "gpl"))
RULES = tuple(r for rule in LICENSES for r in (_OR_LATER if rule[0] == "GPL-3.0-or-later" else (rule,)))
#: Lines with an SPDX tag become paragraphs; then sentences end at blank lines and closing marks, but not at a company's dot.
TAGGED = r"(?im)^(.*spdx-license-identifier.*)$"
CUT = r"\n[^\p{L}\p{N}\n]*\n|[;!?](?=\s|$)|(?<!\b(?i:inc|ltd|corp|co|llc|univ|dept))[.](?=\s|$)"


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (known sentences in order), licenses (sorted, each once), all_rights_reserved."""
    text = F.expr("coalesce(cast(text as string), '')").alias("t")
    normal = r"trim(regexp_replace(lower(s), r'[^\p{L}\p{N}]+', ' '))"
    found = ", ".join(f"struct(regexp_instr(s, r'{p}') as at, {k} as k, '{name}' as id)" for k, (name, p) in enumerate(PATTERNS))
    ids = f"transform(array_sort(filter(array({found}), f -> f.at > 0)), f -> f.id)"
    cut = rf"split(regexp_replace(t, r'{TAGGED}', '\n\n$1\n\n'), r'{CUT}')"
    step = docs.select("doc_id", text).select(
        "doc_id",
        F.expr(
            f"case when lower(t) rlike r'{CUE}' then flatten(transform(transform(filter({cut}, s -> lower(s) rlike r'{CUE}'), s -> {normal}), s -> {ids}))"
            " else cast(array() as array<string>) end"
        ).alias("sentence_ids"),
    )
    step = step.withColumn("left", F.expr("concat(',', array_join(sentence_ids, ',,'), ',')")).withColumn("got", F.expr("cast(array() as array<string>)"))
    for name, needs in RULES:
        # Of several sentences that could open a rule, the last before the next one is taken.
        pattern = "".join(f",{n},((?:(?!,{n},).)*?)" for n in needs[:-1]) + f",{needs[-1]},"
        between = "".join(f"${k}" for k in range(1, len(needs)))
        step = step.select(
            "doc_id",
            "sentence_ids",
            F.expr(f"regexp_replace(left, '{pattern}', '{between}')").alias("left"),
            F.expr(f"case when left rlike '{pattern}' then concat(got, array('{name}')) else got end").alias("got"),
        )
    return step.select(
        "doc_id",
        "sentence_ids",
        F.expr("array_sort(array_distinct(filter(got, g -> g <> 'GPL' or not exists(got, x -> startswith(x, 'GPL-')))))").alias("licenses"),
        F.expr("array_contains(sentence_ids, 'reserved')").alias("all_rights_reserved"),
    )


def _sequence(needs: tuple[str, ...]) -> str:
    return ".*?".join(f",{n}," for n in needs)


def sql() -> str:
    """The same in DuckDB's SQL."""
    cue = " or ".join(f"contains(lower(t), '{c}')" for c in CUES)
    near = " or ".join(f"contains(lower(s), '{c}')" for c in NEAR)
    ids = "case " + " ".join(f"when regexp_matches(s, '{p}') then '{name}'" for name, p in SENTENCES) + " end"
    normal = r"trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g'))"
    # A sentence ends at a line break, or at a closing mark before white space or the end.
    cut = r"string_split_regex(regexp_replace(t, '[.;!?](\s|$)', chr(10) || '\1', 'g'), '\n')"
    steps = [
        f"s0 as (select doc_id, case when {cue} then list_filter(list_transform(list_transform(list_filter({cut}, lambda s: {near}), lambda s: {normal}), lambda s: {ids}),"
        f" lambda s: s is not null) else [] end as ids from (select doc_id, coalesce(text, '') as t from documents))",
        "l0 as (select doc_id, ids, ',' || array_to_string(ids, ',,') || ',' as rest, '' as got from s0)",
    ]
    for k, (name, needs) in enumerate(LICENSES):
        p = _sequence(needs)
        steps.append(
            f"l{k + 1} as (select doc_id, ids, regexp_replace(rest, '{p}', ',', 'g') as rest,"
            f" case when regexp_matches(rest, '{p}') then got || ',{name}' else got end as got from l{k})"
        )
    return (
        "with " + ",\n".join(steps) + f"\nselect doc_id, array_to_string(ids, ',') as sentence_ids,"
        " array_to_string(list_sort(list_distinct(list_filter(string_split(got, ','), lambda x: x <> ''))), ',') as licenses,"
        f" list_contains(ids, 'reserved') as all_rights_reserved from l{len(LICENSES)}"
    )
