"""Mentions of licenses by identifier, abbreviation and name, and texts that hold none."""

import pyarrow as pa
import pytest

from factloom.llm import licenses
from tests.llm.test_corpus_operators import forms_of

MENTIONS = {
    "Licensed under GPL-3.0": "gpl-3.0", "licensed under the BSD license": "bsd", "Creative Commons Attribution 4.0": "cc-by-4.0", "GNU LGPL v2.1": "lgpl-2.1", "CC BY-SA 4.0": "cc-by-sa-4.0", "MIT licensed": "mit",
    "It is GPLv2 code.": "gpl-2.0", "GPL version 2 or later": "gpl-2.0", "the terms of the GPL": "gpl", "AGPL-3.0-only": "agpl-3.0", "LGPLv3": "lgpl-3.0", "Apache-2.0": "apache-2.0", "Apache licensed": "apache", "the Apache License, Version 2.0": "apache,apache-2.0",
    "BSD-3-Clause": "bsd-3-clause", "a two-clause BSD license": "bsd-2-clause", "0BSD": "0bsd", "MPL-2.0": "mpl-2.0", "EPL 2.0": "epl-2.0", "EUPL-1.2": "eupl-1.2", "CDDL 1.1": "cddl-1.1", "CC0 1.0 Universal": "cc0-1.0", "CC-BY-NC-ND 4.0": "cc-by-nc-nd-4.0",
    "CC BY-NC-SA 3.0": "cc-by-nc-sa-3.0", "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0", "released under MIT": "mit", "WTFPL": "wtfpl", "ISC licensed": "isc", "X11 license": "mit",
    "SIL OFL 1.1": "ofl-1.1", "SPDX-License-Identifier: BSL-1.0": "bsl-1.0", "Creative  Commons\nAttribution-NonCommercial 4.0 International": "cc-by-nc-4.0", "SSPL v1": "sspl-1.0", "Microsoft Public License": "ms-pl", "GNU FDL": "fdl", "Artistic License 2.0": "artistic-2.0",
}
CLEAN = ("Sie kam mit 0 Punkten und mit 2 Taschen.", "please cc by email 4 times", "Apache helicopters 2 by 2", "a driver's license expired", "he went to MIT in 2004", "open source software 3.0", "The new public library is general", "Accord, success and replies 1 0", "my zlib build, isc bind and json files", "BSD sockets", "version 2 of the report")


@pytest.mark.parametrize("text", MENTIONS)
def test_mention(text):
    kept, base = licenses.detect(text.lower())
    assert ",".join(sorted({k[2] for k in kept} | {b[1] for b in base})) == MENTIONS[text]
    assert any(g in text.lower().encode() for g in licenses.GATES)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert licenses.detect(text.lower()) == ([], [])


def test_every_rule_is_gated(monkeypatch):
    """No text that a mention's regex matches is lost to its gate word, or to those of all rules, whatever parts the words."""
    lines = [(label, t) for label, _, pattern, _ in licenses.MENTIONS for t in forms_of(pattern.replace("[a-z]{2}", "de").replace("licen[sc]e", "license").split("(?!")[0])]
    texts = [gap.join(t.split()) for _, t in lines for gap in ("\n", "-", ": ")]
    gated = list(licenses._rows(pa.array(texts)))
    monkeypatch.setattr(licenses, "GATES", (b"",))
    monkeypatch.setattr(licenses, "_RULES", [(i, label, (), pattern, weight) for i, label, _, pattern, weight in licenses.rules()])
    free = list(licenses._rows(pa.array(texts)))
    assert [t for t, a, b in zip(texts, gated, free) if a != b] == []
    assert len(texts) > 1000 and all(r[5] for r in gated)
    assert all(0 < weight < 1 for *_, weight in licenses.MENTIONS)
