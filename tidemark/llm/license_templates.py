"""License texts and notices as templates: fixed values.

Mark-up: ``[[ ... ]]`` is optional, ``{{n}}`` stands for 0 to n words that may be anything. Words are
compared in lower case, and everything that is not a letter, a digit or above 0x7F separates words.
A label of a license is given for its whole text; a notice that only names or refers to a license has
a label of its own, ending in ``-notice``.
"""

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_CLAIM = "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_ENDORSE = "neither the name of {{12}} nor the names of [[its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = (
    "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits"
    " or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_HEAD = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    "the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages"
    " or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)


def _gnu(name: str, version: str) -> str:
    """The notice of a program under a GNU license."""
    return (
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation [[either]] version {version} [[of the license]] [[or at your option any later version]]"
        f" {{{{6}}}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} public license for more details"
    )


def _named(*names: str) -> list[str]:
    """Short notices: a file is under a license of one of the names."""
    return [f"{verb} under [[the terms of]] the {name} license" for name in names for verb in ("is", "are", "available", "distributed", "licensed", "released")]


TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
        f" {_AS_IS} and noninfringement in no event shall {{{{8}}}} {_CLAIM}"
    ],
    "bsd-2-clause": [f"{_BSD_HEAD} {_BSD_TAIL}"],
    "bsd-3-clause": [f"{_BSD_HEAD} [[3]] {_BSD_ENDORSE} {_BSD_TAIL}"],
    "isc": [f"{_ISC_HEAD} provided that the above copyright notice and this permission notice appear in all copies {_ISC_TAIL}"],
    "0bsd": [f"{_ISC_HEAD} {_ISC_TAIL}"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications"
        " and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"
    ],
    "bsl-1.0": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"
        " and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software"
        f" unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor {_AS_IS} title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability"
        " whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
        " in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"
        f" we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_AS_IS} and noninfringement in no event shall the authors {_CLAIM}"
    ],
    "apache-2.0-notice": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed under the license"
        " is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0",
        "spdx license identifier apache 2 0",
    ],
    "gpl-2.0-notice": [_gnu("general", "2"), "licensed under the gnu general public license [[as published by the free software foundation]] version 2", "spdx license identifier gpl 2 0 [[only]] [[or later]]"],
    "gpl-3.0-notice": [_gnu("general", "3"), "licensed under the gnu general public license [[as published by the free software foundation]] version 3", "spdx license identifier gpl 3 0 [[only]] [[or later]]"],
    "lgpl-notice": [_gnu("lesser general", "2 1"), _gnu("lesser general", "3"), "licensed under the [[terms of the]] gnu lesser general public license", "spdx license identifier lgpl {{2}} [[only]] [[or later]]"],
    "agpl-notice": [_gnu("affero general", "3"), "licensed under the [[terms of the]] gnu affero general public license", "spdx license identifier agpl {{2}} [[only]] [[or later]]"],
    "mpl-2.0-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "spdx license identifier mpl 2 0"],
    "mit-notice": [*_named("mit"), "spdx license identifier mit"],
    "bsd-notice": [*_named("[[new]] [[simplified]] [[modified]] bsd [[2 clause]] [[3 clause]]"), "spdx license identifier bsd {{1}} clause"],
    "isc-notice": [*_named("isc"), "spdx license identifier isc"],
    "cc-by-4.0": ["licensed under [[a]] cc by [[version]] 4 0", "licensed under [[a]] [[the]] creative commons attribution 4 0 [[international]] [[license]]"],
    "cc-by-sa-4.0": ["licensed under [[a]] cc by sa [[version]] 4 0", "licensed under [[a]] [[the]] creative commons attribution sharealike 4 0 [[international]] [[license]]"],
    "cc-by-nc-4.0": ["licensed under [[a]] cc by nc [[version]] 4 0", "licensed under [[a]] [[the]] creative commons attribution noncommercial 4 0 [[international]] [[license]]"],
    "cc-by-nd-4.0": ["licensed under [[a]] cc by nd [[version]] 4 0", "licensed under [[a]] [[the]] creative commons attribution noderivatives 4 0 [[international]] [[license]]"],
    "cc0-1.0-notice": ["cc0 1 0 universal", "spdx license identifier cc0 1 0"],
    "copyright": ["copyright [[c]] {{8}} all rights reserved"],
}
