"""Licence notices over several lines, of each kind of line in the test tables, and several in a line."""

import random
import textwrap

from pyspark.sql import functions as F

from vellum.llm import license_scan

KINDS = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
}
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."


def test_notices(spark):
    rnd = random.Random(4)
    filler = lambda: " ".join(rnd.choice(("the", "code", "and", "public", "version", "of", "terms", "rights", "all")) for _ in range(9))
    docs = [(i, "\n".join(filler() for _ in range(4))) for i in range(60)]
    want = set()

    def add(text, *found):
        docs.append((len(docs), text))
        want.update((len(docs) - 1, *x) for x in found)

    for line, family in KINDS.items():
        add(f"{filler()}\n{line}\n{filler()}", (1, family))
    for notice, family in ((MIT, "mit"), (BSD, "bsd-3-clause"), (GPL.format(3), "gpl-3.0"), (GPL.format(2), "gpl-2.0")):
        add(f"x\n\n{notice}\n\ny", (2, family))
        add(f"{filler()}\n{filler()}\n{notice}\n{filler()}", (2, family))
        add("\n".join(f" * {x}" for x in notice.split("\n")), (0, family))
        add("\n".join(textwrap.wrap(notice, 24)), (0, family))
        add(f"{notice}\n\n{notice}", (0, family), (notice.count("\n") + 2, family))
        add(notice.replace("\n", "\n\n"))
    add("Copyright 2020 Some Name. All rights reserved. Released under the MIT License.", (0, "all-rights-reserved"), (0, "mit"))
    add("Licensed under CC BY 4.0. The data are licensed under CC BY-NC 4.0.", (0, "cc-by-4.0"), (0, "cc-by-nc-4.0"))
    add("Released under the MIT License.\nReleased under the MIT License.\nAll rights reserved.", (0, "mit"), (1, "mit"), (2, "all-rights-reserved"))
    add("all the rights are reserved, the license of the public")
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            add(f"{filler()}\n{t}", (1, family))
    docs += [(None, "Released under the MIT License."), (7, None), (8, "")]
    found = [(r.doc_id, r.line, r.family) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == want | {(None, 0, "mit")}


def test_every_kind_of_line_in_the_tables(spark):
    """At sf0.1, whose junk lines repeat a word hundreds of times: all lines that are a notice are found, with their family, and
    nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph")).where(F.col("paragraph").isin(*KINDS))
    want = {(r.doc_id, r.line, KINDS[r.paragraph]) for r in lines.collect()}
    assert {x[2] for x in want} == set(KINDS.values()) and len(want) > 300
    found = {(r.doc_id, r.line, r.family) for r in license_scan.scan(docs).collect()}
    assert want <= found
    texts = {(r.doc_id, r.line): r.paragraph for r in docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph")).where(F.regexp_like("paragraph", F.lit("(?i)licen|reserved"))).collect()}
    other = {x for x in found - want if not any(k.lower() in texts.get(x[:2], "").lower() for k in KINDS)}
    assert not other, [(x, texts.get(x[:2])) for x in other]


def test_repeated_words_are_unknown(spark):
    model, families, asked = license_scan.train(spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate((w, n) for w in ("As", "License", "rights", "version") for n in (1, 5, 40, 400, 4000))], "doc_id long, text string"))
    assert 0 < asked < 1
    kinds = spark.createDataFrame([(k,) for k in KINDS] + [("License " * 500,), ("As " * 3000,)], "paragraph string")
    scored = model.transform(license_scan.featurised(kinds)).select("paragraph", "prediction").collect()
    assert {r.paragraph: families[int(r.prediction)] for r in scored if r.paragraph in KINDS} == KINDS
    assert {families[int(r.prediction)] for r in scored if r.paragraph not in KINDS} == {license_scan.UNKNOWN}
