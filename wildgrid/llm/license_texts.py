"""License wording as templates in markup, by label.

<<beginOptional>> ... <<endOptional>> may be left out; <<var;name=...;max=N>> stands for up to N words.  Case and punctuation
do not count.  Whole licenses come first, then the notices and statements by which texts name a license.
"""

_AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<beginOptional>>NONINFRINGEMENT<<endOptional>><<beginOptional>>NON-INFRINGEMENT<<endOptional>>.
IN NO EVENT SHALL THE <<var;name=holders;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_COPYRIGHT = "<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=copyright;max=24>> <<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>"

_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;name=first;max=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;name=second;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name=provider;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=holders;max=12>> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

TEMPLATES = {
    "mit": (
        f"""<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
substantial portions of the Software. {_AS_IS_MIT}""",
        "<<beginOptional>>released<<endOptional>> under the mit license",
    ),
    "isc": (
        f"""<<beginOptional>>ISC License<<endOptional>> {_COPYRIGHT}
Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=author;max=6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL <<var;name=holder;max=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
        "under the isc license",
    ),
    "bsd-2-clause": (f"{_COPYRIGHT} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}", "under the <<beginOptional>>simplified<<endOptional>> bsd 2 clause license"),
    "bsd-3-clause": (
        f"""{_COPYRIGHT} {_BSD_CONDITIONS} <<var;name=third;max=1>> Neither the name of <<var;name=organization;max=16>> nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
        "under the <<beginOptional>>new<<endOptional>> bsd 3 clause license",
    ),
    "bsd": ("under the bsd license",),
    "zlib": (
        f"""<<beginOptional>>zlib License<<endOptional>> {_COPYRIGHT}
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions:
<<var;name=first;max=1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required.
<<var;name=second;max=1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<var;name=third;max=1>> This notice may not be removed or altered from any source distribution.""",
        "under the zlib license",
    ),
    "bsl-1": (
        """<<beginOptional>>Boost Software License - Version 1.0 - August 17th, 2003<<endOptional>>
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all
copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "under the boost software license",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
<<beginOptional>>For more information, please refer to <<var;name=address;max=6>><<endOptional>>""",
    ),
    "apache-2": (
        f"""{_COPYRIGHT} Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at <<var;name=address;max=12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
        "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>",
    ),
    "gpl": (
        """This program is free software<<beginOptional>>: you can<<endOptional>><<beginOptional>>; you can<<endOptional>> redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either version <<var;name=version;max=2>> of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details.
<<beginOptional>>You should have received a copy of the GNU General Public License along with this program. <<beginOptional>>If not, see <<var;name=address;max=8>><<endOptional>><<endOptional>>""",
        "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;name=version;max=1>>",
    ),
    "lgpl": ("under the <<beginOptional>>terms of the<<endOptional>> gnu lesser general public license",),
    "mpl-2": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
<<var;name=address;max=8>>""",
        "subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0",
    ),
    "cc-by-nc": (
        "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc <<beginOptional>>4 0<<endOptional>>",
        "creative commons attribution noncommercial <<var;name=version;max=2>> <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license",
    ),
    "cc-by": (
        "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0",
        "creative commons attribution <<beginOptional>>4 0<<endOptional>> <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license",
    ),
}
