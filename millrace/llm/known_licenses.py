"""Known licence texts, digests and notices, and equivalent spellings. Fixed values."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so"""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_MIT = f"""{_MIT_GRANT}, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
{_MIT_DISCLAIMER}"""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: license_id: text. Copyright lines are left out, as in canonical form.
LICENSES = {
    "MIT": _MIT,
    "MIT-0": f"{_MIT_GRANT}.\n{_MIT_DISCLAIMER}",
    "ISC": f"{_ISC_GRANT}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n{_ISC_DISCLAIMER}",
    "0BSD": f"{_ISC_GRANT}.\n{_ISC_DISCLAIMER}",
    "BSD-2-Clause": f"{_BSD_TOP}\n{_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"""{_BSD_TOP}
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.
{_BSD_DISCLAIMER}""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.
Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
}

#: license_id: words and SHA-256 of the canonical form of a text that is too long to stand here.
#: (terms): up to the end of the terms and conditions, without advice on applying them.
DIGESTS: dict[str, tuple[int, str]] = {
    "Apache-2.0": (1606, "2e7cecc56c13c99192beab9a7d2362eecbcf9701f14bd12777f7ef56a375f374"),
    "Apache-2.0 (terms)": (1429, "622fc03e7533c5f35400f87ba05aef4aa91efa281c18741e99ef504cc8c78ad0"),
    "Artistic-1.0-Perl": (983, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    "CC0-1.0": (1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    "GFDL-1.2": (3315, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    "GFDL-1.3": (3732, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    "GPL-1.0": (2067, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    "GPL-1.0 (terms)": (1641, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    "GPL-2.0": (2975, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    "GPL-2.0 (terms)": (2504, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    "GPL-3.0": (5684, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    "GPL-3.0 (terms)": (5241, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    "LGPL-2.0": (4200, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    "LGPL-2.0 (terms)": (3865, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    "LGPL-2.1": (4401, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    "LGPL-2.1 (terms)": (4065, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    "LGPL-3.0": (1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    "MPL-1.1": (3786, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    "MPL-2.0": (2426, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
}

#: license_id: names by which a notice calls it.
NAMES = {
    "MIT": ("the MIT License", "MIT", "the MIT License (MIT)"),
    "ISC": ("the ISC License", "ISC"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "the Modified BSD License", "BSD-3-Clause"),
    "Zlib": ("the zlib License", "Zlib"),
    "Unlicense": ("the Unlicense", "Unlicense"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "BSL-1.0"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License, v. 2.0", "MPL 2.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0", "EPL 2.0"),
    **{
        f"{short}-{number}": (f"the GNU {name} General Public License, version {number[0]}", f"the GNU {name} General Public License version {number}", f"the GNU {name} General Public License v{number}", f"{short}v{number[0]}", f"the {short}v{number[0]}", f"{short} {number}")
        for short, name, numbers in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser", ("3.0",)), ("AGPL", "Affero", ("3.0",)))
        for number in numbers
    },
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL 2.1"),
    "CC0-1.0": ("CC0 1.0", "CC0", "the Creative Commons CC0 1.0 Universal License"),
    **{
        f"CC-{terms}-{number}": (f"CC {terms} {number}", f"a Creative Commons {name} {number} International License", f"the Creative Commons {name} {number} License")
        for terms, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivs"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs"))
        for number in ("3.0", "4.0")
    },
}
#: What a notice says about the name.
NOTICES = (
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "This work is licensed under {}.", "This file is licensed under {}.", "This project is licensed under {}.",
    "This software is licensed under {}.", "This software is released under {}.", "This program is licensed under {}.", "This project is licensed under the terms of {}.", "Licensed under the terms of {}.", "License: {}", "SPDX-License-Identifier: {}",
)


def notices() -> dict[str, str]:
    """text: license_id (notice) of every notice with every name, and with the identifier itself."""
    out = {notice.format(name): f"{i} (notice)" for i, names in NAMES.items() for name in (*names, i) for notice in NOTICES}
    return out | {"All rights reserved.": "All rights reserved (notice)"}


#: Spelling: the one it is replaced by.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "https": "http",
}
