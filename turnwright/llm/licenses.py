"""Licence recognition by sentence rules.

A text is cut into sentences, each brought to a normal form (lower case, runs of anything but ASCII letters and
digits as one blank). Known sentences have identifiers; the identifiers of a text, in order and without the
sentences that are not known, are matched against the ordered licence rules. A rule is a sequence of identifiers;
what an earlier rule has matched is used up, so that a full licence text is not taken for its parts as well.

Sentences may be wrapped: the lines between those that are known by themselves are read as one, from any of them to the
last, up to a terminator or a blank line (in comments, a line of the comment mark alone). A licence is also recognised
where a sentence names it ("licensed under the ..."), and by a line ``SPDX-License-Identifier`` of one licence.

Cases: a null or empty text has no sentences. Rows that repeat are scanned each. Sentences may stand anywhere in a
text of any length, and a licence is listed as often as it is found in ``n_matches`` but once in ``licenses``."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.functions.text import bound
from turnwright.llm.common import as_documents

#: Licences by SPDX identifier, with how their names read in normal form.
NAMES: dict[str, str] = {
    "Apache-2.0": r"apache( license| software license)?( ?version| ?v)? ?2( 0)?( the license)?",
    "MIT": r"mit|expat",
    "GPL-3.0": r"(gnu )?(general public license|gpl)( ?version| ?v)? ?3( 0)?",
    "BSD-3-Clause": r"(3 clause|new|modified|revised) bsd|bsd 3 clause",
    "BSD-2-Clause": r"(2 clause|simplified|freebsd) bsd|bsd 2 clause",
    "CC-BY-NC-4.0": r"cc by nc 4 0|(a )?creative commons attribution non ?commercial 4 0( international)?",
    "CC-BY-4.0": r"cc by 4 0|(a )?creative commons attribution 4 0( international)?",
    "MPL-2.0": r"mozilla public license( ?version| ?v)? ?2( 0)?|mpl ?v?2 0",
    "GPL-2.0": r"(gnu )?(general public license|gpl)( ?version| ?v)? ?2( 0)?",
    "LGPL-2.1": r"(gnu )?(lesser general public license|lgpl)( ?version| ?v)? ?2 1",
    "LGPL-3.0": r"(gnu )?(lesser general public license|lgpl)( ?version| ?v)? ?3( 0)?",
    "AGPL-3.0": r"(gnu )?(affero general public license|agpl)( ?version| ?v)? ?3( 0)?",
    "MPL-1.1": r"mozilla public license( ?version| ?v)? ?1 1|mpl ?v?1 1",
    "EPL-1.0": r"eclipse public license( ?version| ?v)? ?1( 0)?|epl ?v?1 0",
    "EPL-2.0": r"eclipse public license( ?version| ?v)? ?2( 0)?|epl ?v?2 0",
    "CDDL-1.0": r"common development and distribution license( ?version| ?v)? ?1( 0)?|cddl ?v?1 0",
    "EUPL-1.2": r"european union public licen[cs]e( ?version| ?v)? ?1 2|eupl ?v?1 2",
    "0BSD": r"zero clause bsd|bsd zero clause|0bsd",
    "ISC": r"isc",
    "Zlib": r"zlib",
    "BSL-1.0": r"boost software license( ?version| ?v)? ?1 0|bsl ?1 0",
    "Unlicense": r"unlicense",
    "CC0-1.0": r"cc0( 1 0)?( universal)?|creative commons zero( v1 0| 1 0)?( universal)?",
    "CC-BY-3.0": r"cc by 3 0|(a )?creative commons attribution 3 0( unported)?",
    "CC-BY-SA-3.0": r"cc by sa 3 0|(a )?creative commons attribution share ?alike 3 0( unported)?",
    "CC-BY-SA-4.0": r"cc by sa 4 0|(a )?creative commons attribution share ?alike 4 0( international)?",
    "CC-BY-ND-4.0": r"cc by nd 4 0|(a )?creative commons attribution no ?derivatives 4 0( international)?",
    "CC-BY-NC-SA-4.0": r"cc by nc sa 4 0|(a )?creative commons attribution non ?commercial share ?alike 4 0( international)?",
    "CC-BY-NC-ND-4.0": r"cc by nc nd 4 0|(a )?creative commons attribution non ?commercial no ?derivatives 4 0( international)?",
    "Artistic-2.0": r"artistic license( ?version| ?v)? ?2( 0)?",
    "PostgreSQL": r"postgresql",
    "PSF-2.0": r"python software foundation( license)?( ?version| ?v)?( ?2)?( 0)?|psf( license)?( ?version)?( 2 0)?",
    "OFL-1.1": r"sil open font license( ?version| ?v)? ?1 1|ofl ?1 1",
    "MS-PL": r"microsoft public license|ms pl",
    "NCSA": r"university of illinois ncsa open source|ncsa",
    "MulanPSL-2.0": r"mulan (psl|permissive software license)( ?version| ?v)? ?2( 0)?",
}
#: How a sentence that names its licence begins.
NAMED = (
    r"((this|the) [a-z0-9]+( [a-z0-9]+)? (is|are) |it is )?(released|licensed|distributed|published|available|made available|provided) "
    r"under( the)?( terms of)?( the)? "
)


#: Identifiers of such sentences that are not made from the licence's.
NOTICES = {"Apache-2.0": "ApacheNotice", "MIT": "MitNotice", "GPL-3.0": "GplNotice", "CC-BY-NC-4.0": "CcByNcNotice", "CC-BY-4.0": "CcByNotice"}


def notice(spdx: str) -> str:
    """The identifier of sentences that name a licence."""
    return NOTICES.get(spdx, f"{spdx}-Notice")


def naming(spdx: str) -> str:
    """The pattern of sentences that name a licence, and of its SPDX line."""
    tag = re.sub("[^a-z0-9]+", " ", spdx.lower())
    return rf"{NAMED}({NAMES[spdx]})( licen[cs]e)?( or (any )?later( version)?| only)?|spdx license identifier {tag}( only| or later)?"


#: Known sentences in normal form; ``.*`` stands for a name, a year or a variant.
SENTENCES: dict[str, str] = {
    "ApacheUse": r"you may not use this file except in compliance with the license",
    "ApacheCopy": r"you may obtain a copy of the license at( http.*)?",
    "ApacheAsIs": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",
    "ApacheSee": r"see the license for the specific language governing permissions and limitations under the license",
    "ApacheTitle": r"apache license version 2 0 january 2004( http.*)?",
    "ApacheTerms": r"terms and conditions for use reproduction and distribution",
    "MitGrant": r"permission is hereby granted free of charge to any person obtaining a copy of this software.*",
    "MitCondition": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "AsIsSoftware": r"the software is provided as is without warranty of any kind.*",
    "NoLiability": r"in no event shall the authors or copyright holders be liable for any claim.*",
    "GplFree": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 3 of the license.*",
    "GplFree2": r"this (program|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 2 of the license.*",
    "LgplFree": r"this (program|library) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license.*version 2 1 of the license.*",
    "LgplFree3": r"this (program|library) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license.*version 3 of the license.*",
    "AgplFree": r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license.*version 3 of the license.*",
    "GplNoWarranty": r"this (program|library) is distributed in the hope that it will be useful but without any warranty.*",
    "GplCopy": r"you should have received a copy of the gnu (lesser |affero )?general public license along with this (program|library).*",
    "GplTitle2": r"gnu general public license version 2 june 1991",
    "GplTitle3": r"gnu general public license version 3 29 june 2007",
    "LgplTitle": r"gnu lesser general public license version 2 1 february 1999",
    "LgplTitle3": r"gnu lesser general public license version 3 29 june 2007",
    "AgplTitle": r"gnu affero general public license version 3 19 november 2007",
    "MplTitle": r"mozilla public license version 2 0",
    "EplTitle": r"eclipse public license v 2 0",
    "EplOffer": r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0.*",
    "IscGrant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that.*",
    "ZeroGrant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "IscAsIs": r"the software is provided as is and the author disclaims all warranties.*",
    "IscLiability": r"in no event shall the author be liable for any special direct indirect or consequential damages.*",
    "BoostTitle": r"boost software license version 1 0.*",
    "BoostGrant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software.*",
    "ZlibAsIs": r"this software is provided as is without any express or implied warranty",
    "ZlibGrant": r"permission is granted to anyone to use this software for any purpose including commercial applications.*",
    "ZlibOrigin": r"(1 )?the origin of this software must not be misrepresented.*",
    "UnlicenseDomain": r"this is free and unencumbered software released into the public domain",
    "UnlicenseGrant": r"anyone is free to copy modify publish use compile sell or distribute this software.*",
    "BsdGrant": r"redistribution and use in source and binary forms with or without modification are permitted.*",
    "BsdSource": r"(1 )?redistributions of source code must retain the above copyright notice.*",
    "BsdBinary": r"(2 )?redistributions in binary form must reproduce the above copyright notice.*",
    "BsdEndorse": r"(3 )?neither the name of .* may be used to endorse or promote products.*",
    "BsdAsIs": r"this software is provided by .* as is and any express or implied warranties.*",
    "MplNotice": r"this source code form is subject to the terms of the mozilla public license v 2 0",
    "AllRights": r"all rights reserved",
    **{notice(spdx): naming(spdx) for spdx in NAMES},
}

#: Licence rules in order of precedence; after them each name by itself.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("ApacheTitle", "ApacheTerms")),
    ("Apache-2.0", ("ApacheNotice", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MitGrant", "MitCondition", "AsIsSoftware", "NoLiability")),
    ("MIT", ("MitGrant", "MitCondition", "AsIsSoftware")),
    ("GPL-3.0", ("GplFree", "GplNoWarranty", "GplCopy")),
    ("GPL-2.0", ("GplFree2", "GplNoWarranty", "GplCopy")),
    ("LGPL-2.1", ("LgplFree", "GplNoWarranty", "GplCopy")),
    ("LGPL-3.0", ("LgplFree3", "GplNoWarranty", "GplCopy")),
    ("AGPL-3.0", ("AgplFree", "GplNoWarranty", "GplCopy")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("ISC", ("IscGrant", "IscAsIs", "IscLiability")),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("0BSD", ("ZeroGrant", "IscAsIs", "IscLiability")),
    ("0BSD", ("ZeroGrant", "IscAsIs")),
    ("Zlib", ("ZlibAsIs", "ZlibGrant", "ZlibOrigin")),
    ("BSL-1.0", ("BoostTitle", "BoostGrant")),
    ("Unlicense", ("UnlicenseDomain", "UnlicenseGrant")),
    ("Apache-2.0", ("ApacheNotice", "ApacheUse")),
    ("GPL-3.0", ("GplFree",)),
    ("GPL-2.0", ("GplFree2",)),
    ("LGPL-2.1", ("LgplFree",)),
    ("LGPL-3.0", ("LgplFree3",)),
    ("AGPL-3.0", ("AgplFree",)),
    ("GPL-3.0", ("GplTitle3",)),
    ("GPL-2.0", ("GplTitle2",)),
    ("LGPL-2.1", ("LgplTitle",)),
    ("LGPL-3.0", ("LgplTitle3",)),
    ("AGPL-3.0", ("AgplTitle",)),
    ("MPL-2.0", ("MplTitle",)),
    ("MPL-2.0", ("MplNotice",)),
    ("EPL-2.0", ("EplTitle",)),
    ("EPL-2.0", ("EplOffer",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Unlicense", ("UnlicenseDomain",)),
    *[(spdx, (notice(spdx),)) for spdx in NAMES],
)

#: Rules of several sentences, in order; then what is left counts for the rules of one sentence, which cannot meet.
LONG_RULES = tuple(r for r in RULES if len(r[1]) > 1)
SHORT_RULES = {r[1][0]: r[0] for r in RULES if len(r[1]) == 1}
ORDER = tuple(dict.fromkeys(r[0] for r in RULES))
#: Any known sentence has one of these, so that other sentences are passed over before they are normalised.
CUE = (
    r"(?i)licen|permission|warrant|liable|redistribut|endorse|copy of the|all rights|free software|unencumbered|misrepresented"
    r"|free to copy|terms and conditions|(released|distributed|published|available|provided) under"
).replace(" ", "[^a-z0-9]+")
#: And each cue has one of these, which are quicker to look for.
STEMS = ("licen", "permission", "warrant", "liable", "redistribut", "endorse", "copy", "rights", "software", "unencumbered", "misrepresented", "conditions", "under")
END = r"([.!?;])[ \t\r\n]+"
#: Between sentences that may be wrapped: after a terminator, or at blank lines; ``CUT`` is put there.
BLANK = r"\n(?:[ \t\r]*(?:[#*;%/]+|--+)?[ \t\r]*\n)+"
CUT = "\x02"
#: Around the identifier of a known line.
MARK = "\x03"


def normal_form(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def known_as(form: Column, wrap: Callable[[str], str]) -> Column:
    """The identifier of the first pattern that ``form`` matches, null if there is none.

    ``form`` is worked out once, and read once by all patterns together, so that only known sentences are read by each."""
    known = wrap("|".join(SENTENCES.values()))

    def pick(f: Column) -> Column:
        out = F.when(~f.rlike(known), F.lit(None).cast("string"))
        for name, pattern in SENTENCES.items():
            out = out.when(f.rlike(wrap(pattern)), F.lit(name))
        return out

    return F.get(F.transform(F.array(form), pick), F.lit(0))


def sentence_id(form: Column) -> Column:
    """The identifier of a normalised sentence, null if it is not known."""
    return known_as(form, lambda p: rf"\A({p})\z")


def wrapped_id(sentence: Column) -> Column:
    """The identifier of what begins at one of the sentence's lines and ends with it, null if it is not known."""
    form = F.regexp_replace(F.regexp_replace(F.lower(sentence), r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*", "~")
    return known_as(F.trim(form, F.lit(" ~")), lambda p: rf"(\A|~)({p.replace(' ', '[ ~]')})\z")


def cued(sentence: Column) -> Column:
    """Whether a sentence has a cue."""
    some = bound(lambda low: reduce(operator.or_, [low.contains(x) for x in STEMS]), F.lower(sentence))
    return some & sentence.rlike(CUE)


def marked_lines(sentence: Column) -> Column:
    """The sentence with each line that is known by itself replaced by its identifier between marks."""
    line = lambda x: F.coalesce(F.when(x.rlike(CUE), F.concat(F.lit(MARK), sentence_id(normal_form(x)), F.lit(MARK))), x)
    return F.array_join(F.transform(F.split(sentence, "\n"), line), "\n")


def part_id(part: Column, number: Column) -> Column:
    """The identifier of a part between marks: every second is one, the others are lines that may be one sentence."""
    lines = F.trim(part, F.lit("\n"))
    return F.when(number % 2 == 1, part).when(lines.contains("\n") & lines.rlike(CUE), wrapped_id(lines))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, n_matches of every row; lists are joined by commas."""
    base = as_documents(docs, "doc_id", "text")
    lines = F.split(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), END, "$1\n"), "\n")
    step = base.withColumn("_lines", F.filter(lines, lambda x: F.length(F.trim(x, F.lit(" \t\r"))) > 0))
    cut = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit(" ")), END, f"$1{CUT}"), BLANK, CUT)
    step = step.withColumn("_cued", F.filter(F.split(cut, CUT), cued))
    # Joined, sentences stay apart: a cut is a mark of an empty identifier.
    marked = F.array_join(F.transform("_cued", marked_lines), MARK + MARK)
    step = step.withColumn("_parts", F.split(marked, MARK))
    step = step.withColumn("_ids", F.filter(F.transform("_parts", part_id), lambda x: x.isNotNull() & (x != "")))
    step = step.withColumn("_rest", F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(",")))
    # Each rule takes its matches out of the sequence; a bar keeps what lay around them apart.
    for number, (_, sequence) in enumerate(LONG_RULES):
        key = f",{',,'.join(sequence)},"
        step = step.withColumn(f"_n{number}", F.expr(f"cast((length(_rest) - length(replace(_rest, '{key}', ''))) / {len(key)} as long)"))
        step = step.withColumn("_rest", F.replace(F.col("_rest"), F.lit(key), F.lit("|")))
    counts = [F.col(f"_n{i}") for i in range(len(LONG_RULES))]
    short = F.create_map(*[F.lit(x) for pair in SHORT_RULES.items() for x in pair])
    left = F.transform(F.split("_rest", "[,|]+"), lambda x: F.try_element_at(short, x))
    step = step.withColumn("_left", F.array_compact(left))
    hits = F.array_compact(F.concat("_left", F.array(*[F.when(n > 0, F.lit(r[0])) for n, r in zip(counts, LONG_RULES)])))
    step = step.withColumn("_hits", hits)
    return step.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_intersect(F.array(*[F.lit(x) for x in ORDER]), "_hits"), ",").alias("licenses"),
        (sum(counts, F.lit(0)) + F.size("_left")).cast("long").alias("n_matches"),
    )


def duckdb_sql() -> str:
    """The same scan in DuckDB's SQL, built from the same tables."""
    case = " ".join(f"when regexp_full_match(f, '{p}') then '{n}'" for n, p in SENTENCES.items())
    wrapped = " ".join(rf"when regexp_matches(f, '(\A|~)({p.replace(' ', '[ ~]')})\z') then '{n}'" for n, p in SENTENCES.items())
    steps, rest = [], "r0"
    for i, (_, sequence) in enumerate(LONG_RULES):
        key = f",{',,'.join(sequence)},"
        steps.append(
            f"s{i} as (select *, cast((length({rest}) - length(replace({rest}, '{key}', ''))) / {len(key)} as bigint) as n{i}, "
            f"replace({rest}, '{key}', '|') as r{i + 1} from {f's{i - 1}' if i else 'b'})"
        )
        rest = f"r{i + 1}"
    short = " ".join(f"when '{n}' then '{name}'" for n, name in SHORT_RULES.items())
    names = ", ".join(f"case when n{i} > 0 then '{r[0]}' end" for i, r in enumerate(LONG_RULES))
    order = ", ".join(f"'{name}'" for name in ORDER)
    total = " + ".join(f"n{i}" for i in range(len(LONG_RULES)))
    return rf"""
with d as (
  select row_number() over () as rid, doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '{END}', '\1' || chr(10), 'g'), chr(10)),
    lambda x: length(trim(x, ' ' || chr(9) || chr(13))) > 0) as ls,
    list_filter(string_split(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(3), ' '), '{END}', '\1' || chr(2), 'g'), '{BLANK}', chr(2), 'g'), chr(2)),
      lambda x: regexp_matches(x, '{CUE}')) as ss
  from documents),
u as (select rid, unnest(ss) as s, generate_subscripts(ss, 1) as k from d),
l as (select rid, k, unnest(string_split(s, chr(10))) as x, generate_subscripts(string_split(s, chr(10)), 1) as j from u),
f as (select rid, k, j, x, case when regexp_matches(x, '{CUE}') then trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) end as f from l),
m as (select rid, k, j, x, case {case} end as id from f),
o as (select *, count(id) over (partition by rid, k order by j) as part from m),
q as (select rid, k, part, 0 as half, max(id) as id, '' as f from o where id is not null group by rid, k, part union all
  select rid, k, part, 1, null, trim(regexp_replace(regexp_replace(lower(string_agg(x, chr(10) order by j)), '[^a-z0-9\n]+', ' ', 'g'), ' ?\n[ \n]*', '~', 'g'), ' ~')
  from o where id is null group by rid, k, part having count(*) > 1 and regexp_matches(string_agg(x, chr(10) order by j), '{CUE}')),
z as (select rid, k, part, half, coalesce(id, case {wrapped} end) as id from q),
g as (select rid, list(id order by k, part, half) as ids from z where id is not null group by rid),
i as (select doc_id, ls, coalesce(ids, []) as ids from d left join g using (rid)),
b as (select *, ',' || coalesce(array_to_string(ids, ',,'), '') || ',' as r0 from i),
{', '.join(steps)},
e as (select *, list_filter(list_transform(string_split_regex({rest}, '[,|]+'), lambda x: case x {short} end), lambda x: x is not null) as short from s{len(LONG_RULES) - 1})
select doc_id, cast(len(ls) as bigint) as n_sentences, coalesce(array_to_string(ids, ','), '') as sentence_ids,
  coalesce(array_to_string(list_filter([{order}], lambda x: list_contains(list_concat(short, [{names}]), x)), ','), '') as licenses,
  cast({total} + len(short) as bigint) as n_matches
from e
"""
