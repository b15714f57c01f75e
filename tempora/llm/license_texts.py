"""Wordings by which texts state their license.

Rows of (license, pattern that the matched stretch must hold, wording).  The pattern holds versions
and, in short notices, names; it is searched in the folded stretch.  Where it has a group ``id``, the
license is what stands there, and the stretch ends with it.
"""

from __future__ import annotations

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {_GNU_TAIL}"


def _commons(clause: str) -> str:
    return f"This work is licensed under a Creative Commons {clause} 4.0 International License"


def _unported(clause: str) -> str:
    return f"This work is licensed under a Creative Commons {clause} 3.0 Unported License"


def _brief(code: str, version: str = "4.0") -> str:
    return f"Licensed under CC {code} {version}"


def _gnu_only(name: str, version: str) -> str:
    return f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation"


def _gnu_text(name: str, version: str, years: str) -> str:
    return f"GNU {name} {version} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


_GAP = r"[\s,.v-]{0,4}"

TEMPLATES: list[tuple[str, str, str]] = [
    ("AGPL-3.0-or-later", r"version 3\b(?!\.\d)", _gnu("Affero General Public License", "3")),
    ("Apache-1.1", r"apache.*\b1\.1\b", "Licensed under the Apache Software License, Version 1.1"),
    ("Apache-2.0", r"apache.*\b2\.0\b", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", r"apache.*\b2\.0\b", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD", "", _BSD_HEAD),
    ("BSD-2-Clause", "", f"{_BSD_HEAD} {_BSD_ONE} {_BSD_TWO}"),
    ("BSD-3-Clause", "", f"{_BSD_HEAD} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE}"),
    ("BSL-1.0", r"boost.*\b1\.0\b", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", r"\b4\.0", _commons("Attribution")),
    ("CC-BY-4.0", rf"\bby{_GAP}4\.0", _brief("BY")),
    ("CC-BY-NC-4.0", r"\b4\.0", _commons("Attribution-NonCommercial")),
    ("CC-BY-NC-4.0", rf"\bby.nc{_GAP}4\.0", _brief("BY-NC")),
    ("CC-BY-NC-ND-4.0", r"\b4\.0", _commons("Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-ND-4.0", rf"\bby.nc.nd{_GAP}4\.0", _brief("BY-NC-ND")),
    ("CC-BY-NC-SA-4.0", r"\b4\.0", _commons("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-SA-4.0", rf"\bby.nc.sa{_GAP}4\.0", _brief("BY-NC-SA")),
    ("CC-BY-ND-4.0", r"\b4\.0", _commons("Attribution-NoDerivatives")),
    ("CC-BY-ND-4.0", rf"\bby.nd{_GAP}4\.0", _brief("BY-ND")),
    ("CC-BY-SA-4.0", r"\b4\.0", _commons("Attribution-ShareAlike")),
    ("CC-BY-SA-4.0", rf"\bby.sa{_GAP}4\.0", _brief("BY-SA")),
    ("CC0-1.0", r"cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", r"eclipse.*\b2\.0\b", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("GPL-2.0", r"gnu.*version 2\b(?!\.\d)", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0-or-later", r"version 2\b(?!\.\d)", _gnu("General Public License", "2")),
    ("GPL-3.0", r"gnu.*version 3\b(?!\.\d)", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", r"version 3\b(?!\.\d)", _gnu("General Public License", "3")),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1-or-later", r"version 2\.1\b", _gnu("Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", r"version 3\b(?!\.\d)", _gnu("Lesser General Public License", "3")),
    ("MIT", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}'),
    ("MIT", r"\bmit\b", "Released under the MIT License"),
    ("MPL-1.1", r"mozilla.*\b1\.1\b", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1"),
    ("MPL-2.0", r"mozilla.*\b2\.0\b", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("all-rights-reserved", "", "All rights reserved"),
    ("{id}", r"spdx-license-identifier: {0,2}(?P<id>[a-z0-9][\w.+-]*(?: (?:and|or|with) [a-z0-9][\w.+-]*)*)", "SPDX-License-Identifier:"),
    ("{id}", r"released under the (?P<id>[a-z][a-z.+-]*[0-9][\w.+-]*|isc|zlib|unlicense|epl|mpl) licen[sc]e", "Released under the"),
    ("MIT", r"\bthe mit license\b", "or the MIT license"),
    ("MIT", r"\bmit license \(mit\)", "The MIT License (MIT)"),
    ("Apache-2.0", r"apache license.*version 2\.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", r"gnu general public.*version 2\b", _gnu_text("GENERAL PUBLIC LICENSE", "Version 2, June 1991", "1989, 1991")),
    ("GPL-3.0", r"gnu general public.*version 3\b", _gnu_text("GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007", "2007")),
    ("AGPL-3.0", r"gnu affero.*version 3\b", _gnu_text("AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007", "2007")),
    ("LGPL-2.1", r"gnu lesser.*version 2\.1\b", _gnu_text("LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999", "1991, 1999")),
    ("LGPL-3.0", r"gnu lesser.*version 3\b", _gnu_text("LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007", "2007")),
    ("GPL-2.0-only", r"version 2 as published", _gnu_only("General Public License", "2")),
    ("GPL-3.0-only", r"version 3 as published", _gnu_only("General Public License", "3")),
    ("LGPL-2.1-only", r"version 2\.1 as published", _gnu_only("Lesser General Public License", "2.1")),
    ("CC-BY-3.0", r"\b3\.0 unported", _unported("Attribution")),
    ("CC-BY-3.0", rf"\bby{_GAP}3\.0", _brief("BY", "3.0")),
    ("CC-BY-SA-3.0", r"\b3\.0 unported", _unported("Attribution-ShareAlike")),
    ("CC-BY-SA-3.0", rf"\bby.sa{_GAP}3\.0", _brief("BY-SA", "3.0")),
    ("CC-BY-NC-3.0", r"\b3\.0 unported", _unported("Attribution-NonCommercial")),
    ("CC-BY-NC-SA-3.0", r"\b3\.0 unported", _unported("Attribution-NonCommercial-ShareAlike")),
    ("proprietary", "", "All rights reserved. No part of this document may be reproduced without permission"),
]
