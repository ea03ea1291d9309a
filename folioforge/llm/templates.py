"""Licence texts as markup, matched word by word (operator 9 reads these).

`<<optional>> ... <<end>>` may be left out; `<<any n>>` stands for up to n words of any kind (a
name, a year, a title); `<<id>>`, at the end, is an identifier that becomes part of the label. Everything
else is mandatory wording. The wording of the licences is fixed.
"""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of <<any 6>> and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<optional>> (including the next paragraph) <<end>> shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 10>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, <<optional>> and/or <<end>> <<optional>> and <<end>> distribute this software for any
purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<any 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<optional>> 1 <<end>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<optional>> 2 <<end>> Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""
_BSD3 = """ <<optional>> 3 <<end>> Neither the name of <<any 12>> nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """ THIS SOFTWARE IS PROVIDED BY <<any 10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 10>> BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 <<optional>> (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 <<optional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. <<end>> <<end>>"""
_GNU = """This {} is free software <<optional>> ; you can redistribute it and/or modify it <<end>> under the terms of the GNU {}
General Public License as published by the Free Software Foundation <<optional>> ; either <<end>> version {} of the License"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at <<optional>> http <<end>> <<optional>> https <<end>> mozilla.org/MPL/2.0"""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License <<optional>> v
<<end>> {} which <<optional>> is available at <<end>> <<optional>> accompanies this distribution <<end>>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will <<any 6>> be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<optional>> 1 <<end>> The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an <<any 1>> in the product documentation would be appreciated but is not required. <<optional>> 2 <<end>> Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. <<optional>> 3 <<end>> This
notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant,
this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL
THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. """ + _MIT_WARRANTY
_CC = """This <<any 2>> is licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons Attribution {} <<optional>> 4.0
<<end>> <<optional>> 3.0 <<end>> <<optional>> International <<end>> <<optional>> Unported <<end>> License"""
_CC0 = "To the extent possible under law, <<any 8>> has waived all copyright and related or neighboring rights to"

#: Label and markup of each template.
TEMPLATES: dict[str, str] = {
    "text:mit": _MIT_GRANT + " " + _MIT_WARRANTY,
    "text:isc": _ISC,
    "text:bsd-2-clause": _BSD + _BSD_WARRANTY,
    "text:bsd-3-clause": _BSD + _BSD3 + _BSD_WARRANTY,
    "text:apache-2.0": _APACHE,
    "text:gpl-2.0": _GNU.format("program", "", "2"),
    "text:gpl-3.0": _GNU.format("program", "", "3"),
    "text:lgpl-2.0": _GNU.format("library", "Library", "2"),
    "text:lgpl-2.1": _GNU.format("library", "Lesser", "2.1"),
    "text:lgpl-3.0": _GNU.format("<<any 2>>", "Lesser", "3"),
    "text:agpl-3.0": _GNU.format("program", "Affero", "3"),
    "text:mpl-2.0": _MPL,
    "text:epl-1.0": _EPL.format("1.0"),
    "text:epl-2.0": _EPL.format("2.0"),
    "text:zlib": _ZLIB,
    "text:bsl-1.0": _BOOST,
    "text:unlicense": _UNLICENSE,
    "text:cc-by": _CC.format(""),
    "text:cc-by-sa": _CC.format("ShareAlike"),
    "text:cc-by-nc": _CC.format("NonCommercial"),
    "text:cc-by-nc-sa": _CC.format("NonCommercial ShareAlike"),
    "text:cc0-1.0": _CC0,
    "notice:mit": "<<optional>> this <<any 3>> is <<end>> released under the MIT License",
    "notice:gpl": "<<optional>> this <<any 3>> is <<end>> released under the GNU General Public License",
    "notice:cc-by": "licensed under <<optional>> a <<end>> <<optional>> creative commons <<end>> CC BY <<optional>> 4.0 <<end>> <<optional>> international <<end>>",
    "notice:all-rights-reserved": "<<optional>> copyright <<any 8>> <<end>> all rights reserved",
    "notice:mit-style": "MIT-style license",
    "notice:bsd-style": "BSD-style license that can be found in the LICENSE file",
    "spdx": "SPDX-License-Identifier <<id>>",
}
