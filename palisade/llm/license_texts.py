"""Fixed texts of public licences: names as sentences give them, notices, and short full texts."""

from __future__ import annotations

#: Beginnings of a sentence that names a licence.
FORMS = ["Licensed under {}.", "Released under {}.", "Distributed under {}.",
         "This work is licensed under {}.", "This software is licensed under {}."]

#: Licence -> names.
NAMES = {
    "0BSD": ["the BSD Zero Clause License", "the 0BSD License"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3",
                 "the GNU Affero General Public License v3.0", "the GNU AGPL v3"],
    "Apache-1.1": ["the Apache License, Version 1.1", "the Apache Software License, Version 1.1"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0",
                   "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License",
                     "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "CC-BY-3.0": ["CC BY 3.0", "a Creative Commons Attribution 3.0 License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0",
                     "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": [
        "CC BY-NC-ND 4.0",
        "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": [
        "CC BY-NC-SA 4.0",
        "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0",
                     "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 3.0 License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0",
                     "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"],
    "EPL-1.0": ["the Eclipse Public License, version 1.0", "the Eclipse Public License v1.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License v2.0",
                "the Eclipse Public License 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0",
                "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0",
                "the GNU GPL v3"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1",
                 "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3",
                 "the GNU Lesser General Public License v3.0", "the GNU LGPL v3"],
    "MIT": ["the MIT License", "the MIT license terms"],
    "MPL-1.1": ["the Mozilla Public License, version 1.1"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "Unlicense": ["the Unlicense license"],
    "Zlib": ["the zlib License", "the zlib/libpng License"],
}

_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. ")
_NO_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission. ")
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_GNU = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU {name} as published by the Free Software Foundation, either version {version} of the "
    "License, or (at your option) any later version.")
_GNU_OLD = (
    "This {thing} is free software; you can redistribute it and/or modify it under the terms of the "
    "GNU {name} as published by the Free Software Foundation; version {version} of the License.")

#: Licence -> notices and full texts.
TEXTS = {
    "AGPL-3.0": [_GNU.format(thing="program", name="Affero General Public License", version="3"),
                 "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "BSD-2-Clause": [_REDISTRIBUTION + _AS_IS],
    "BSD-3-Clause": [_REDISTRIBUTION + _NO_NAMES + _AS_IS],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0": [_GNU.format(thing="program", name="General Public License", version="2"),
                _GNU_OLD.format(thing="program", name="General Public License", version="2"),
                "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": [_GNU.format(thing="program", name="General Public License", version="3"),
                "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS."],
    "LGPL-2.1": [
        _GNU.format(thing="library", name="Lesser General Public License", version="2.1"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": [
        _GNU.format(thing="program", name="Lesser General Public License", version="3"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        'all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions"],
}

#: Words that tell licences apart, beside words with a digit.
DECIDING = set(
    "affero agpl apache attribution boost bsd by cc cc0 clause commons creative eclipse epl gnu gpl "
    "isc lesser lgpl libpng library mit mozilla mpl nc nd new noncommercial noderivatives noderivs sa "
    "sharealike simplified unlicense zero zlib".split())


def templates() -> dict[str, str]:
    """All texts by ``licence/number``."""
    out = {}
    for name in sorted({*NAMES, *TEXTS}):
        found = [form.format(own) for own in NAMES.get(name, []) for form in FORMS]
        for k, text in enumerate([*found, *TEXTS.get(name, [])]):
            out[f"{name}/{k:02d}"] = text
    return out
