import re
from pathlib import Path

import pytest
from cases import ODD, frame

from millrace.llm import licenses
from millrace.llm.known_licenses import DIGESTS, LICENSES


def test_forms_of_a_licence(spark):
    mit = LICENSES["MIT"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Some Body\n\n" + mit.upper().replace(" ", "\n  ").replace('"', "''")),
        (3, f"© 1999 X\nThe MIT License (MIT)\n{mit}"),
        (4, mit + " And one more word."),
        (5, "text\nThis work is licenced under the GNU General Public Licence - version 3\nReleased under the MIT License.\nreleased under the mit licence"),
        (6, LICENSES["Zlib"].replace("acknowledgment", "acknowledgement")),
        (7, "All rights reserved.\n"),
        (8, "BSD 3-Clause License\n\n Copyright 2001 X. \nAll rights reserved.\n" .replace("\n\n", "\n") + LICENSES["BSD-3-Clause"]),
        (9, "licensed under CC BY 4.0"),
        (10, "# x\n# SPDX-License-Identifier: Apache-2.0\n * Licenced under the Apache Licence, Version 2.0"),
        *ODD,
    ]
    got = {(r.doc_id, r.license_id): (r.whole, r.n_lines, r.first_line) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {
        (1, "MIT"): (True, 0, None),
        (2, "MIT"): (True, 0, None),
        (3, "MIT"): (True, 0, None),
        (5, "GPL-3.0 (notice)"): (False, 1, 1),
        (5, "MIT (notice)"): (False, 2, 2),
        (6, "Zlib"): (True, 0, None),
        (7, "All rights reserved (notice)"): (False, 1, 0),
        (8, "BSD-3-Clause"): (True, 0, None),
        (8, "All rights reserved (notice)"): (False, 1, 2),
        (9, "CC-BY-4.0 (notice)"): (True, 1, 0),
        (10, "Apache-2.0 (notice)"): (False, 2, 1),
    }
    assert licenses.scan(frame(spark, [])).count() == 0


def test_digests_differ(spark):
    known = licenses.known(spark).groupBy("digest").count()
    assert known.where("count > 1").count() == 0
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0 (terms)", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(DIGESTS)


FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not (FOLDER / "GPL-3").exists(), reason="no texts here")
def test_long_licences_in_other_forms(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    rows = []
    for n, f in enumerate(files):
        lines = (FOLDER / f).read_text().splitlines()
        out = []
        for line in lines:  # other breaks, but around copyright lines and titles, which stay lines
            alone = "copyright" in line.lower() or "(c)" in line.lower() or line.strip() == "Apache License"
            out += [line] if alone else [w.swapcase() + ("," if w.isalpha() else "") for w in line.split()]
        rows.append((n, re.sub(r"\bPROGRAM\b", "PROGRAMME;", re.sub(r"\bLICENSES\b", "LICENCES", "\n".join(out)))))
        rows.append((100 + n, "\n".join(lines) + "\nmore"))
    got = {r.doc_id: r.license_id for r in licenses.scan(frame(spark, rows)).where("whole").collect()}
    assert got == dict(enumerate(files.values()))
