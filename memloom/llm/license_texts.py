"""Licence notices and texts that files are compared with."""

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
)
_APACHE_END = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
    "not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
    "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
)


def _gnu(name: str, version: str, program: str = "program") -> list[str]:
    """Notices of a GNU licence."""
    short = f"This work is licensed under the {name}, version {version}."
    free = (
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. "
    )
    end = (
        f"This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along "
        f"with this {program}. If not, see <https://www.gnu.org/licenses/>."
    )
    return [short, f"Licensed under the {name} version {version}.", f"{name} version {version}", free, free + end]


def _spdx(*ids: str) -> list[str]:
    return [f"SPDX-License-Identifier: {i}" for i in ids]


def _creative(code: str, name: str, url: str) -> list[str]:
    long = f"Creative Commons {name} 4.0 International License"
    return [f"Licensed under CC {code} 4.0.", f"This work is licensed under a {long}.", f"This work is licensed under the {long}. To view a copy of this license, visit http://creativecommons.org/licenses/{url}/4.0/"]


#: Short notices, headers and whole texts by licence.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", *_spdx("MIT"), _MIT, _MIT + _NOTICE + _WARRANTY, "The MIT License (MIT) Copyright (c) " + _MIT + _NOTICE + _WARRANTY],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", *_spdx("Apache-2.0"), _APACHE, _APACHE + _APACHE_END, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "GPL-2.0": [*_spdx("GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"), *_gnu("GNU General Public License", "2")],
    "GPL-3.0": [*_spdx("GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"), *_gnu("GNU General Public License", "3")],
    "LGPL-2.1": [*_spdx("LGPL-2.1-only", "LGPL-2.1-or-later"), *_gnu("GNU Lesser General Public License", "2.1", "library")],
    "LGPL-3.0": [*_spdx("LGPL-3.0-only", "LGPL-3.0-or-later"), *_gnu("GNU Lesser General Public License", "3", "library")],
    "AGPL-3.0": [*_spdx("AGPL-3.0-only", "AGPL-3.0-or-later"), *_gnu("GNU Affero General Public License", "3")],
    "MPL-2.0": [*_spdx("MPL-2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", *_spdx("BSD-2-Clause"), _BSD + _BSD1 + _BSD2 + _BSD_END, "BSD 2-Clause License Copyright (c) All rights reserved. " + _BSD + _BSD1 + _BSD2 + _BSD_END],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", *_spdx("BSD-3-Clause"), _BSD + _BSD1 + _BSD2 + _BSD3 + _BSD_END, "BSD 3-Clause License Copyright (c) All rights reserved. " + _BSD + _BSD1 + _BSD2 + _BSD3 + _BSD_END],
    "ISC": ["Licensed under the ISC License.", *_spdx("ISC"), _ISC, _ISC + _ISC_END],
    "Zlib": ["Licensed under the zlib License.", *_spdx("Zlib"), _ZLIB],
    "Unlicense": [*_spdx("Unlicense"), _UNLICENSE, _UNLICENSE + _WARRANTY],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", *_spdx("BSL-1.0"), "Boost Software License - Version 1.0 " + _BOOST + _WARRANTY],
    "CC-BY-4.0": [*_spdx("CC-BY-4.0"), *_creative("BY", "Attribution", "by")],
    "CC-BY-SA-4.0": [*_spdx("CC-BY-SA-4.0"), *_creative("BY-SA", "Attribution-ShareAlike", "by-sa")],
    "CC-BY-NC-4.0": [*_spdx("CC-BY-NC-4.0"), *_creative("BY-NC", "Attribution-NonCommercial", "by-nc")],
    "CC0-1.0": [*_spdx("CC0-1.0"), "CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Proprietary": ["All rights reserved.", "Copyright (c) All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Phrases that stand beside other licences, too.
WEAK = frozenset({"Proprietary"})
