"""Public licence texts in full, notices and titles that stand for a licence, and digests of long texts."""

from __future__ import annotations

UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT_0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
BSD_CLAUSES = (
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
)
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."


def titled(body: str, *titles: str) -> list[str]:
    """A text alone and below each of its titles, without and with the line of rights that often stands before it."""
    return [title + rights + body for title in ("", *(f"{t}\n" for t in titles)) for rights in ("", "All rights reserved.\n")]


def _bsd(n: int, *titles: str) -> list[str]:
    """The BSD licence of ``n`` clauses, numbered and not, with both words for the holder that its templates use."""
    out = []
    for tail in (BSD_TAIL, BSD_TAIL.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")):
        for numbered in (True, False):
            clauses = [f"{k}. {c}" if numbered else c for k, c in enumerate(BSD_CLAUSES[:n], 1)]
            out += titled("\n".join([BSD_HEAD, *clauses, tail]), *titles)
    return out


def _gnu(name: str, version: str) -> list[str]:
    """The notices that the GNU licences ask for: the grant alone, and with the two paragraphs that follow it."""
    out = []
    for what in ("program", "library", "software", "file"):
        start = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
        warranty = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
        for grant in (f"{start}either version {version} of the License, or (at your option) any later version.", f"{start}version {version} of the License.", f"{start}version {version}."):
            out += [grant, f"{grant}\n{warranty}"]
            out += [f"{grant}\n{warranty}\nYou should have received a copy of the GNU {name} along with this {what}. If not, see <{url}>." for url in ("https://www.gnu.org/licenses/", "http://www.gnu.org/licenses/")]
    return out


def _named(*names: str) -> list[str]:
    return [form.format(name) for name in names for form in ("{}", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.")]


def _spdx(*ids: str) -> list[str]:
    return [f"SPDX-License-Identifier: {x}" for x in ids]


MORE = {
    "MIT": [*_named("MIT License", "MIT license"), "The MIT License (MIT)", "This project is licensed under the MIT License - see the LICENSE file for details.", *_spdx("MIT")],
    "ISC": [*_named("ISC License"), *_spdx("ISC")],
    "MIT-0": [*titled(MIT_0, "MIT No Attribution", "MIT No Attribution (MIT-0)", "MIT-0"), "MIT No Attribution", *_spdx("MIT-0")],
    "0BSD": [*titled(ZERO_BSD, "BSD Zero Clause License", "Zero-Clause BSD", "0BSD"), "BSD Zero Clause License", *_spdx("0BSD")],
    "BSD-2-Clause": [*_bsd(2, "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), *_named("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"), *_spdx("BSD-2-Clause")],
    "BSD-3-Clause": [*_bsd(3, "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"), *_named("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Revised BSD License"), *_spdx("BSD-3-Clause")],
    "Unlicense": [*titled(UNLICENSE, "The Unlicense", "Unlicense"), *titled(UNLICENSE.replace("http:", "https:"), "The Unlicense"), UNLICENSE.rsplit("\n", 1)[0], "The Unlicense", *_named("Unlicense"), *_spdx("Unlicense")],
    "Zlib": [*titled(ZLIB, "zlib License", "The zlib License"), *_named("zlib License"), *_spdx("Zlib")],
    "BSL-1.0": [*titled(BSL, "Boost Software License - Version 1.0 - August 17th, 2003"), "Boost Software License - Version 1.0 - August 17th, 2003", *_named("Boost Software License, Version 1.0"), *_spdx("BSL-1.0")],
    "Apache-2.0": [*(APACHE_NOTICE.replace("http:", x) for x in ("http:", "https:")), "Apache License\nVersion 2.0, January 2004", *(f"Apache License\nVersion 2.0, January 2004\n{x}://www.apache.org/licenses/" for x in ("http", "https")), *_named("Apache License, Version 2.0", "Apache License 2.0"), *_spdx("Apache-2.0")],
    "GPL-2.0": [*_gnu("General Public License", "2"), "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", *_named("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"), *_spdx("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+")],
    "GPL-3.0": [*_gnu("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", *_named("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"), *_spdx("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+")],
    "LGPL-2.1": [*_gnu("Lesser General Public License", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", *_named("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"), *_spdx("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+")],
    "LGPL-3.0": [*_gnu("Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", *_named("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"), *_spdx("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+")],
    "AGPL-3.0": [*_gnu("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", *_named("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"), *_spdx("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")],
    "MPL-2.0": [*(MPL_NOTICE.format(x) for x in ("http", "https")), "Mozilla Public License Version 2.0", *_named("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"), *_spdx("MPL-2.0")],
    "EPL-2.0": [*_named("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"), "Eclipse Public License - v 2.0", *_spdx("EPL-2.0")],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Legal Code\nCC0 1.0 Universal", *_named("CC0 1.0"), *_spdx("CC0-1.0")],
    "CC-BY-4.0": [*_named("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"), "Licensed under CC BY 4.0.", *_spdx("CC-BY-4.0")],
    "CC-BY-SA-4.0": [*_named("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International"), "Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", *_spdx("CC-BY-SA-4.0")],
    "CC-BY-NC-4.0": [*_named("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International"), *_spdx("CC-BY-NC-4.0")],
}
MORE_PARTS = {
    "BSD-3-Clause": [BSD_CLAUSES[2], f"3. {BSD_CLAUSES[2]}"],
    "Unlicense": [UNLICENSE.split("\n")[0]],
    "BSL-1.0": [BSL.split("\n")[0]],
    "Apache-2.0": [APACHE_NOTICE.split("\n")[0], 'Licensed under the Apache License, Version 2.0 (the "License");'],
}
#: SHA-256 of the canonical form of whole long texts as Debian distributes them; then without what follows the end of the terms.
LONG = {
    "Apache-2.0": ["045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87", "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166"],
    "Artistic-1.0-Perl": ["08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"],
    "BSD-3-Clause": ["3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2": ["5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"],
    "GFDL-1.3": ["93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"],
    "GPL-1.0": ["9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"],
    "GPL-3.0": ["5a03c45024821019e59bbbf8d5bd13f8395e4e13204f3e1cf7fb58b2422ec219", "ad4a8c0f86b40eeaec03087f95684ff7965ffea480d1a58d4d7d9cb5ea929725", "a3befc99a52b31d6651d10d3a5453a64872b0c7adfec0f91a471a9df284d545d"],
    "LGPL-2.0": ["289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"],
    "LGPL-2.1": ["5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"],
}
