"""License notices and texts as templates: ``[[optional words]]``, ``{{n}}`` a place for up to n words of any kind.

The wording is fixed (public license texts and the notices that their authors ask for); case and punctuation don't matter.
"""

from __future__ import annotations

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {{8}} BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
)
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met"
)
_BSD_CLAUSES = (
    "[[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_ADVERTISING = (
    "[[3]] All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by {{16}}"
)
_BSD_NAMES = (
    "[[3]] [[4]] Neither the name of {{16}} nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of {{6}} and associated documentation files "
    "[[the Software]] to deal in {{4}} without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of {{4}}"
)
_MIT_CONDITIONS = (
    "and to permit persons to whom {{4}} furnished to do so, subject to the following conditions: The above copyright notice "
    "[[and this permission notice]] [[including the next paragraph]] shall be included in all copies or substantial portions of {{4}}"
)
_FREE = "{{8}} is free software: you can redistribute it and/or modify it under the terms of the GNU"
_PUBLISHED = "as published by the Free Software Foundation"
_LATER = "of the License [[or at your option any later version]]"
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"


def _gnu(label: str, kind: str, version: str, dated: str) -> list[tuple[str, str]]:
    """The notice, the short reference, the start of the full text."""
    name = f"GNU {kind} General Public License".replace("  ", " ")
    return [
        (label, f"{_FREE} {kind} General Public License {_PUBLISHED} [[either]] version {version} {_LATER}"),
        (label, f"under the [[terms of the]] {name} [[{_PUBLISHED} {{{{2}}}}]] [[version]] [[v]] {version}"),
        (label, f"under the [[terms of the]] {name} v{version}"),
        (label, f"{name} Version {version}, {dated} Copyright (C) {{{{16}}}} {_VERBATIM}"),
    ]


def _creative() -> list[tuple[str, str]]:
    """Names of the six licenses in their versions, in full and by their letters."""
    out = []
    parts = (("by", ()), ("by-sa", ("ShareAlike",)), ("by-nd", ("NoDerivatives",)), ("by-nc", ("NonCommercial",)), ("by-nc-sa", ("NonCommercial", "ShareAlike")), ("by-nc-nd", ("NonCommercial", "NoDerivatives")))
    for letters, names in parts:
        for version, place in (("4.0", "International"), ("3.0", "Unported"), ("3.0", "United States"), ("2.0", "Generic")):
            out.append((f"cc-{letters}-{version}", f"Creative Commons Attribution {' '.join(names)} {version} {place}"))
        for version in ("4.0", "3.0", "2.0"):
            out.append((f"cc-{letters}-{version}", f"licensed under [[a]] [[the]] CC {letters} {version}"))
    return out


def _identifiers() -> list[tuple[str, str]]:
    ids = (
        "MIT ISC 0BSD Zlib Unlicense BSL-1.0 CC0-1.0 Apache-2.0 MPL-2.0 EPL-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause GPL-2.0 GPL-3.0 "
        "LGPL-2.1 LGPL-3.0 AGPL-3.0 CC-BY-4.0 CC-BY-SA-4.0"
    )
    return [(i.lower(), f"SPDX-License-Identifier: {i}") for i in ids.split()]


TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "licensed under [[the terms of]] the Apache License, [[Version]] 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at {{12}} Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "apache-2.0",
        "Apache License Version 2.0, January 2004 {{8}} TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION [[1]] [[Definitions]] "
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ),
    ("mit", "[[released]] under [[the terms of]] the MIT License"),
    ("mit", _MIT_GRANT),
    ("mit", f"{_MIT_GRANT} {_MIT_CONDITIONS} {_AS_IS}"),
    ("isc", "under [[the terms of]] the ISC License"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        f"that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}",
    ),
    ("0bsd", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_DISCLAIMER}"),
    ("bsd", _BSD_OPENING),
    ("bsd-2-clause", "BSD 2-Clause [[Simplified]] License"),
    ("bsd-3-clause", "BSD 3-Clause [[New or Revised]] License"),
    ("bsd-2-clause", f"{_BSD_OPENING} {_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_OPENING} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsd-4-clause", f"{_BSD_OPENING} {_BSD_CLAUSES} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1]] The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. [[2]] Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. [[3]] This notice may not be removed or altered from "
        "any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of "
        "our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        f"to this software under copyright law. [[{_AS_IS}]]",
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("mpl-2.0", "Mozilla Public License [[Version]] [[v]] 2.0"),
    ("mpl-2.0", "Mozilla Public License v2.0"),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at {{8}}",
    ),
    ("epl-2.0", "under the terms of the Eclipse Public License [[version]] [[v]] 2.0"),
    ("cc0-1.0", "CC0 1.0 Universal [[Public Domain Dedication]]"),
    ("cc0-1.0", "To the extent possible under law, {{12}} waived all copyright and related or neighboring rights to {{12}}"),
    ("reserved", "copyright [[c]] {{8}} all rights reserved"),
    *_gnu("gpl-3.0", "", "3", "29 June 2007"),
    *_gnu("gpl-2.0", "", "2", "June 1991"),
    *_gnu("lgpl-3.0", "Lesser", "3", "29 June 2007"),
    *_gnu("lgpl-2.1", "Lesser", "2.1", "February 1999"),
    *_gnu("agpl-3.0", "Affero", "3", "19 November 2007"),
    *_creative(),
    *_identifiers(),
)
