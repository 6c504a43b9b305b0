"""Texts of public licences and of the notices that name them, by SPDX identifier.

Copyright lines and placeholders are left out, since they differ from work to work.
"""

from .license_texts import FULL_TEXTS

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_FREE = "is free software: you can redistribute it and/or modify it under the terms of the"
_WARRANTY = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"""
_ENDS = (
    "If not, see https://www.gnu.org/licenses/.",
    "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "If not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA.",
)
#: SPDX identifier, name, version, and short names of the GNU licences.
_GNU = (
    ("GPL-1.0", "General", "1", ("GPLv1", "GPL-1.0")),
    ("GPL-2.0", "General", "2", ("GPLv2", "GPL-2.0")),
    ("GPL-3.0", "General", "3", ("GPLv3", "GPL-3.0")),
    ("LGPL-2.0", "Library General", "2", ("LGPLv2", "LGPL-2.0")),
    ("LGPL-2.1", "Lesser General", "2.1", ("LGPLv2.1", "LGPL-2.1")),
    ("LGPL-3.0", "Lesser General", "3", ("LGPLv3", "LGPL-3.0")),
    ("AGPL-3.0", "Affero General", "3", ("AGPLv3", "AGPL-3.0")),
)


def _gnu() -> list[tuple[str, str]]:
    """Long notices, with each work they name and each end, and one-line forms."""
    out = []
    for spdx, name, version, short in _GNU:
        title = f"GNU {name} Public License"
        for work in ("program", "library") if "General" != name and "Affero" not in name else ("program",):
            for end in _ENDS:
                have = f"You should have received a copy of the {title} along with this {work}. {end}"
                for terms in (
                    f"{title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
                    f"{title} version {version} as published by the Free Software Foundation.",
                ):
                    out.append((spdx, f"This {work} {_FREE} {terms} This {work} {_WARRANTY} {title} for more details. {have}"))
        for start in ("This work is licensed", "Licensed", "Released", "This project is licensed", "This program is licensed"):
            out += [(spdx, f"{start} under the {title}, version {version}."), (spdx, f"{start} under the {title} v{version}.")]
            out += [(spdx, f"{start} under the {s} license.") for s in short]
    return out


#: SPDX part and words of the six Creative Commons licences.
_CC = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)


def _creative_commons() -> list[tuple[str, str]]:
    out = []
    for part, words in _CC:
        long = f"This work is licensed under a Creative Commons {words} 4.0 International License."
        url = f"http://creativecommons.org/licenses/{part.lower()}/4.0/"
        lines = [
            long,
            long.replace("under a", "under the"),
            f"{long} To view a copy of this license, visit {url}.",
            f"""{long.replace("under a", "under the")} To view a copy of this license, visit {url} or send a letter to
Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
            f"Licensed under CC {part} 4.0.",
            f"This work is licensed under CC {part} 4.0.",
        ]
        out += [(f"CC-{part}-4.0", line) for line in lines]
    return out


_NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"""{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may
be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_END}"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("MPL-2.0", "Licensed under the MPL 2.0 license."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Licensed under the Simplified BSD License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the New BSD License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document."),
)

TEMPLATES: tuple[tuple[str, str], ...] = (*_NOTICES, *_gnu(), *_creative_commons(), *FULL_TEXTS)
