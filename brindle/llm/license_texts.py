"""Public license texts and notices as templates of the license scan.

<<o>>...<</o>> may be left out, <<v N>> stands for up to N words of any kind, <<a|b>> for one of several wordings; all other words are mandatory. Case, punctuation and
line breaks do not count.
"""

from __future__ import annotations

# Wording of public licenses.
_DISCLAIMER = """
<<this software is|the software is|this software and documentation are>> provided by <<v 12>> "as is" and any express or implied warranties, including, but not limited to, the implied warranties of
merchantability and fitness for a particular purpose are disclaimed. In no event shall <<v 12>> be liable for any direct, indirect, incidental, special, exemplary, or consequential
damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of
liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of
such damage
"""
_BSD_HEAD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<o>>1<</o>> <<o>>a<</o>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<o>>2<</o>> <<o>>b<</o>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution
"""
_ENDORSE = """
<<o>>3<</o>> <<o>>4<</o>> <<o>>c<</o>> Neither the name of <<v 12>> nor the names of <<its|the>> <<o>>copyright holders and<</o>> contributors may be used to endorse or promote products derived from this software without
specific prior written permission
"""
_ADVERTISE = """
<<o>>3<</o>> All advertising materials mentioning features or use of this software must display the following acknowledgement: this product includes software developed by <<v 16>>
"""
_ISC_GRANT = "Permission to use, copy, modify, <<and|and or>> distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """
The software is provided "as is" and <<the author|isc|the authors|the copyright holder>> <<disclaims|disclaim>> all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event
shall <<v 8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of
contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software
"""
_GNU = """
free software <<o>>you<</o>> <<can|may>> redistribute it and/or modify it under the terms of {name} as published by the Free Software Foundation
"""
_CC = "<<licensed|available|released|distributed|published|shared>> under <<o>>the<</o>> <<o>>terms of<</o>> <<o>>the<</o>> <<o>>a<</o>> <<cc|creative commons>> {code} <<o>>public<</o>> <<o>>international<</o>> <<o>>license<</o>> <<v 1>> <<o>>0<</o>>"

TEMPLATES = {
    "mit": [
        "<<released|licensed|distributed|available>> under <<o>>the terms of<</o>> the MIT license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<o>>(including the next paragraph)<</o>> shall be included in all copies or
        substantial portions of the Software. The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
        merchantability, fitness for a particular purpose and noninfringement. In no event shall <<v 8>> be liable for any claim, damages or other liability, whether in an action of
        contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software""",
        "SPDX license identifier: MIT",
    ],
    "apache-2": [
        "<<o>>this work is<</o>> licensed under the Apache License, Version 2<<o>>.0<</o>>",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<http|https>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License""",
        """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to
        reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form""",
        "SPDX license identifier: Apache-2.0",
    ],
    "bsd-2": [_BSD_HEAD + _DISCLAIMER, "SPDX license identifier: BSD-2-Clause", "<<under|licensed under|distributed under>> <<the|a>> <<2 clause bsd|bsd 2 clause|simplified bsd>> license"],
    "bsd-3": [_BSD_HEAD + _ENDORSE + _DISCLAIMER, "SPDX license identifier: BSD-3-Clause", "<<under|licensed under|distributed under>> <<the|a>> <<3 clause bsd|bsd 3 clause|new bsd|modified bsd>> license"],
    "bsd-4": [_BSD_HEAD + _ADVERTISE + _ENDORSE + _DISCLAIMER, "SPDX license identifier: BSD-4-Clause"],
    "isc": [_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY, "<<under|licensed under>> the ISC license", "SPDX license identifier: ISC"],
    "0bsd": [_ISC_GRANT + ". " + _ISC_WARRANTY, "SPDX license identifier: 0BSD"],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
        granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<o>>1<</o>> The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an <<acknowledgment|acknowledgement>> <<o>>(see the following)<</o>> in
        the product documentation would be appreciated but is not required. <<o>>2<</o>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. <<o>>3<</o>> This notice may not be removed or altered from any source distribution""",
        "SPDX license identifier: Zlib",
    ],
    "bsl-1": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
        "distributed under the Boost Software License, Version 1.0",
        "SPDX license identifier: BSL-1.0",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
        as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
        "SPDX license identifier: Unlicense",
    ],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "SPDX license identifier: WTFPL"],
    "gpl-2": [
        _GNU.format(name="the GNU General Public License") + "; <<o>>either<</o>> version 2 <<o>>of the License<</o>> <<o>>, or (at your option) any later version<</o>>",
        "licensed under the <<o>>terms of the<</o>> GNU General Public License <<o>>,<</o>> version 2",
        "SPDX license identifier: GPL-2.0 <<only|or later>>",
    ],
    "gpl-3": [
        "licensed under the <<o>>terms of the<</o>> GNU General Public License version 3",
        _GNU.format(name="the GNU General Public License") + ", <<o>>either<</o>> version 3 <<o>>of the License<</o>> <<o>>, or (at your option) any later version<</o>>",
        "free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the license or <<o>>at your option<</o>> any later version",
        "SPDX license identifier: GPL-3.0 <<only|or later>>",
    ],
    "lgpl-2.1": [
        _GNU.format(name="the GNU Lesser General Public License") + "; <<o>>either<</o>> version 2.1 <<o>>of the License<</o>> <<o>>, or (at your option) any later version<</o>>",
        "SPDX license identifier: LGPL-2.1 <<only|or later>>",
    ],
    "lgpl-3": [
        _GNU.format(name="the GNU Lesser General Public License") + ", <<o>>either<</o>> version 3 <<o>>of the License<</o>> <<o>>, or (at your option) any later version<</o>>",
        "SPDX license identifier: LGPL-3.0 <<only|or later>>",
    ],
    "agpl-3": [
        _GNU.format(name="the GNU Affero General Public License") + ", <<o>>either<</o>> version 3 <<o>>of the License<</o>> <<o>>, or (at your option) any later version<</o>>",
        "SPDX license identifier: AGPL-3.0 <<only|or later>>",
    ],
    "mpl-2": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        <<http|https>>://mozilla.org/MPL/2.0""",
        "SPDX license identifier: MPL-2.0",
    ],
    "epl-2": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License <<o>>v<</o>> <<o>>version<</o>> 2.0 which <<is available|accompanies>>",
        "SPDX license identifier: EPL-2.0",
    ],
    "cc0": [
        "<<o>>to the extent possible under law<</o>> <<v 16>> <<has|have>> waived all copyright and related or neighboring rights to",
        "<<released|dedicated|available|licensed>> under <<o>>the<</o>> <<o>>creative commons<</o>> <<cc0|zero>> <<o>>1.0<</o>>",
        "SPDX license identifier: CC0-1.0",
    ],
    "cc-by": [_CC.format(code="<<by|attribution>> <<2|3|4>>"), "SPDX license identifier: CC-BY-4.0"],
    "cc-by-sa": [_CC.format(code="<<by sa|attribution sharealike|attribution share alike>>"), "SPDX license identifier: CC-BY-SA-4.0"],
    "cc-by-nc": [
        "licensed under <<o>>a<</o>> <<cc|creative commons>> <<by nc|attribution noncommercial|attribution non commercial>> <<v 1>> <<o>>0<</o>>",
        _CC.format(code="<<by nc|attribution noncommercial|attribution non commercial>> <<2|3|4>>"),
        "SPDX license identifier: CC-BY-NC-4.0",
    ],
    "cc-by-nc-sa": [_CC.format(code="<<by nc sa|attribution noncommercial sharealike|attribution non commercial share alike>>"), "SPDX license identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nd": [_CC.format(code="<<by nd|attribution noderivatives|attribution noderivs|attribution no derivatives>>"), "SPDX license identifier: CC-BY-ND-4.0"],
    "cc-by-nc-nd": [_CC.format(code="<<by nc nd|attribution noncommercial noderivatives|attribution noncommercial noderivs>>"), "SPDX license identifier: CC-BY-NC-ND-4.0"],
}
