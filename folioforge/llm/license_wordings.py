"""Wordings of licences: notices, standard headers, titles, SPDX lines and, in license_texts/, whole texts."""

from __future__ import annotations

from pathlib import Path

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License version {1} as published by the Free Software Foundation."
_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."


def _gnu(kind: str, version: str, date: str) -> list[str]:
    name = f"GNU {kind}General Public License"
    headers = [_GNU.format(kind, version), _GNU_ONLY.format(kind, version)]
    return [*headers, *(h + _WARRANTY.format(kind) for h in headers), f"{name} Version {version}, {date}", f"{name} version {version}", f"{name} v{version}", f"Licensed under the {name} v{version if '.' in version else version + '.0'}", f"under the terms of the {name}, version {version} or later"]


def _cc(name: str, code: str) -> list[str]:
    full = f"Creative Commons {name} 4.0 International"
    return [
        f"{full} License", f"{full} Public License", f"This work is licensed under a {full} License.", f"This work is licensed under the {full} License. To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/",
        f"Licensed under a Creative Commons {name} 4.0 license", f"{name} 4.0 International (CC {code.upper()} 4.0)", f"CC {code.upper()} 4.0 license", f"License: CC-{code.upper()}-4.0",
    ]


def _bsd(n: int, kind: str) -> list[str]:
    return [
        f"BSD {n}-Clause License", f"The {n}-Clause BSD License", f"BSD {n}-Clause \"{kind}\" License", f"Licensed under the BSD {n}-Clause License", f"This code is licensed under the {n}-clause BSD license, see the LICENSE file", f"License: BSD-{n}-Clause",
    ]


_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."

HEADERS: dict[str, list[str]] = {
    "AGPL-3.0": _gnu("Affero ", "3", "19 November 2007"),
    "Apache-2.0": [
        _APACHE,
        _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004", "Apache License 2.0", "The Apache Software License, Version 2.0", "This source code is licensed under the Apache 2.0 license found in the LICENSE file in the root directory of this source tree.", "Licensed under the Apache 2.0 license, see the LICENSE file in the project root", "License: Apache-2.0",
    ],
    "BSD-2-Clause": _bsd(2, "Simplified"),
    "BSD-3-Clause": [*_bsd(3, "New"), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": _cc("Attribution", "by"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "by-nc"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "by-sa"),
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "Licensed under CC0 1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", "License: CC0-1.0"],
    "GPL-2.0": _gnu("", "2", "June 1991"),
    "GPL-3.0": _gnu("", "3", "29 June 2007"),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "by-nc-nd"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "by-nc-sa"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "by-nd"),
    "GPL-1.0": _gnu("", "1", "February 1989"),
    "LGPL-2.1": _gnu("Lesser ", "2.1", "February 1999"),
    "MPL-1.1": ["Mozilla Public License Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"],
    "ISC": ["ISC License", "The ISC License", "Licensed under the ISC license, see the LICENSE file", "License: ISC"],
    "LGPL-3.0": _gnu("Lesser ", "3", "29 June 2007"),
    "MIT": [
        "MIT License", "The MIT License (MIT)", "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.", "Licensed under the MIT license, see LICENSE file in the project root", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.",
        "This project is licensed under the terms of the MIT license.", "License: MIT",
    ],
    "MPL-2.0": [_MPL, _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0 (MPL 2.0)", "Licensed under the Mozilla Public License 2.0", "License: MPL-2.0"],
}

_GNU_IDS = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0")


def spdx(license: str) -> list[str]:
    ids = [license, *(license + end for end in ("-only", "-or-later") if license in _GNU_IDS)]
    return [f"SPDX-License-Identifier: {i}" for i in ids]


def whole_texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
