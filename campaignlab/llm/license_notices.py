"""Hand-written signatures of licence notices, clauses and warranty texts.

Fixed values: wording of public licence texts, as lower-cased words, by label and weight.
"""

NOTICES = (
    ("gpl", 0.9, (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation",
        "you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|file|library)",
        "see the gnu general public licen[sc]e for more details",
        "gnu general public licen[sc]e as published by the free software foundation",
        "either version [123](?: 0)? of the licen[sc]e or at your option any later version",
        "the licen[sc]es for most software are designed to take away your freedom to share and change it",
        "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works",
        "(?:gpl|general public licen[sc]e) with (?:the )?(?:classpath|gcc runtime library|font|bison|autoconf|linking) exception",
        "dual licen[sc]ed under (?:the )?(?:gpl|gnu general public licen[sc]e)",
        "any attempt otherwise to copy modify sublicen[sc]e or distribute the program is void and will automatically terminate your rights under this licen[sc]e",
        "this file is covered by the gnu general public licen[sc]e",
    )),
    ("lgpl", 0.9, (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e",
        "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:library|program|software)",
        "see the gnu lesser general public licen[sc]e for more details",
        "gnu lesser general public licen[sc]e as published by the free software foundation",
        "gnu library general public licen[sc]e as published by the free software foundation",
        "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public licen[sc]e",
        "you may convey a combined work under terms of your choice",
    )),
    ("agpl", 0.9, (
        "see the gnu affero general public licen[sc]e for more details",
        "gnu affero general public licen[sc]e as published by the free software foundation",
        "you should have received a copy of the gnu affero general public licen[sc]e along with this program",
        "all users interacting with it remotely through a computer network",
        "the gnu affero general public licen[sc]e is a free copyleft licen[sc]e",
    )),
    ("gfdl", 0.9, (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e",
        "with no invariant sections no front cover texts and no back cover texts",
        "a copy of the licen[sc]e is included in the section entitled gnu free documentation licen[sc]e",
        "gnu free documentation licen[sc]e version 1 [123] or any later version published by the free software foundation",
    )),
    ("apache-2", 0.95, (
        "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e",
        "you may obtain a copy of the licen[sc]e at http(?:s)? www apache org licen[sc]es licen[sc]e 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis",
        "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e",
        "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements",
        "the asf licen[sc]es this file to you under the apache licen[sc]e",
        "apache licen[sc]e version 2 0 january 2004",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e",
    )),
    ("apache-1.1", 0.85, (
        "this product includes software developed by the apache software foundation",
        "the names apache and apache software foundation must not be used to endorse or promote products",
        "products derived from this software may not be called apache nor may apache appear in their name",
    )),
    ("mit", 0.9, (
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise",
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "publish distribute sublicen[sc]e and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "use of this source code is governed by an mit style licen[sc]e",
        "mit licen[sc]e see (?:the )?(?:file )?licen[sc]e(?: file| md| txt)?(?: for details)?",
    )),
    ("mit-0", 0.9, (
        "mit no attribution(?: licen[sc]e)?",
        "(?:spdx licen[sc]e identifier |licen[sc]e )mit 0",
    )),
    ("x11", 0.8, (
        "except as contained in this notice the name of the x consortium shall not be used in advertising",
        "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization",
        "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee",
    )),
    ("bsd", 0.85, (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
        "this software is provided by the (?:regents|author|authors) and contributors as is and any express or implied warranties",
        "be liable for any direct indirect incidental special exemplary or consequential damages",
        "use of this source code is governed by a bsd style licen[sc]e",
        "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})* the regents of the university of california all rights reserved",
    )),
    ("bsd-3", 0.9, (
        "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    )),
    ("bsd-4", 0.9, (
        "all advertising materials mentioning features or use of this software must display the following acknowledgement",
        "this product includes software developed by the university of california berkeley and its contributors",
    )),
    ("bsd-2", 0.7, (
        "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies",
    )),
    ("0bsd", 0.9, (
        "(?:zero|0) clause bsd(?: licen[sc]e)?",
        "bsd zero clause licen[sc]e",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    )),
    ("isc", 0.85, (
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action",
        "copyright (?:c )?(?:[0-9]+ )*internet (?:systems|software) consortium",
    )),
    ("zlib", 0.9, (
        "in no event will the authors be held liable for any damages arising from the use of this software",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
    )),
    ("libpng", 0.85, (
        "libpng versions? (?:[0-9a-z]+ )*(?:are|is) copyright",
        "the png reference library (?:and supporting files )?(?:are|is) supplied as is",
    )),
    ("unlicense", 0.9, (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
        "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
        "for more information please refer to http(?:s)? unlicen[sc]e org",
    )),
    ("mpl-2", 0.95, (
        "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http(?:s)? mozilla org mpl 2 0",
        "this source code form is incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e",
    )),
    ("mpl-1.1", 0.9, (
        "the contents of this file are subject to the mozilla public licen[sc]e version 1 1",
        "mpl 1 1 gpl 2 0 lgpl 2 1",
        "alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e",
        "software distributed under the licen[sc]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[sc]e",
    )),
    ("epl-1", 0.9, (
        "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0",
        "available at http(?:s)? www eclipse org legal epl v10 html",
    )),
    ("epl-2", 0.9, (
        "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0",
        "available at http(?:s)? www eclipse org legal epl (?:v20|2 0)",
        "this source code may also be made available under the following secondary licen[sc]es",
    )),
    ("edl-1", 0.85, (
        "available at http(?:s)? www eclipse org org documents edl v10",
        "accompanying materials are made available under the terms of the eclipse distribution licen[sc]e",
    )),
    ("cddl-1", 0.9, (
        "the contents of this file are subject to the terms of the common development and distribution licen[sc]e",
        "cddl header start",
        "or http(?:s)? www opensolaris org os licensing",
        "you can obtain a copy of the licen[sc]e at http(?:s)? (?:glassfish|javanet) (?:[a-z ]+ )?licen[sc]e",
    )),
    ("eupl-1.2", 0.9, (
        "licen[sc]ed under the eupl version 1 2",
        "as soon they will be approved by the european commission subsequent versions of the eupl",
    )),
    ("boost", 0.9, (
        "distributed under the boost software licen[sc]e version 1 0",
        "see accompanying file licen[sc]e 1 0 txt or copy at http(?:s)? www boost org licen[sc]e 1 0 txt",
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    )),
    ("artistic", 0.85, (
        "this (?:program|module|library|software) is free software you can redistribute it and or modify it under the same terms as perl itself",
        "either the gnu general public licen[sc]e or the artistic licen[sc]e",
        "the intent of this document is to state the conditions under which a package may be copied",
        "licen[sc]ed under the same terms as perl(?: itself)?",
    )),
    ("psf", 0.9, (
        "psf licen[sc]e agreement for python",
        "beopen python open source licen[sc]e agreement",
        "cnri (?:open source )?licen[sc]e agreement",
        "this licen[sc]e agreement is between the python software foundation psf and the individual or organization",
    )),
    ("openssl", 0.85, (
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        "this product includes cryptographic software written by eric young",
        "the openssl toolkit stays under a dual licen[sc]e",
    )),
    ("openldap", 0.9, (
        "openldap public licen[sc]e",
        "openldap is a registered trademark of the openldap foundation",
    )),
    ("ofl", 0.9, (
        "this font software is licen[sc]ed under the sil open font licen[sc]e",
        "with reserved font names?",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself",
        "the goals of the open font licen[sc]e ofl are to stimulate worldwide development of collaborative font projects",
    )),
    ("cc", 0.8, (
        "this work is licen[sc]ed under a creative commons",
        "to view a copy of this licen[sc]e visit http(?:s)? creativecommons org licen[sc]es",
        "or send a letter to creative commons",
        "creative commons corporation is not a law firm and does not provide legal services",
        "(?:share copy and redistribute|adapt remix transform and build upon) the material in any medium or format",
        "you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made",
        "creativecommons org licen[sc]es (?:by|by sa|by nd|by nc|by nc sa|by nc nd) [1-4] [05]",
    )),
    ("cc0", 0.9, (
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "by waiving all of his or her rights to the work worldwide under copyright law",
        "to the extent possible under law (?:[^ ]+ ){1,8}(?:has|have) waived all copyright and related or neighboring rights",
        "creativecommons org publicdomain zero 1 0",
    )),
    ("public-domain", 0.7, (
        "(?:has been|is hereby|was) (?:placed|put|released) (?:in ?to|in) the public domain",
        "in the public domain (?:and )?(?:is|are) not (?:subject to|protected by) copyright",
        "this is a work of the (?:u s|us|united states) government and is not subject to copyright protection",
        "the author disclaims copyright to this source code",
        "in place of a legal notice here is a blessing may you do good and not evil may you find forgiveness public domain",
    )),
    ("wtfpl", 0.9, (
        "you just do what the fuck you want to",
        "everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document",
    )),
    ("beerware", 0.9, (
        "if we meet some day and you think this stuff is worth it you can buy me a beer in return",
        "the beer ware licen[sc]e revision 42",
    )),
    ("json", 0.85, (
        "the software shall be used for good not evil(?: licen[sc]e)?",
    )),
    ("ncsa", 0.85, (
        "neither the names of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "university of illinois ncsa open source licen[sc]e",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal with the software",
    )),
    ("ms-pl", 0.85, (
        "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e",
        "licen[sc]ed under the (?:microsoft public licen[sc]e|ms pl)",
        "copyright (?:c )?microsoft corporation all rights reserved licen[sc]ed under the mit licen[sc]e",
    )),
    ("sspl", 0.9, (
        "if you make the functionality of the program or a modified version available to third parties as a service",
        "server side public licen[sc]e (?:version 1 )?as published by mongodb",
    )),
    ("elastic-2", 0.9, (
        "licen[sc]ed under the elastic licen[sc]e(?: 2 0)?",
        "you may not provide the software to third parties as a hosted or managed service",
        "licen[sc]ed to elasticsearch b v under one or more contributor licen[sc]e agreements",
    )),
    ("busl", 0.9, (
        "the licen[sc]or hereby grants you the right to copy modify create derivative works redistribute and make non production use",
        "business source licen[sc]e 1 1 (?:parameters|terms)",
        "additional use grant (?:[^ ]+ ){0,12}licen[sc]e",
    )),
    ("polyform", 0.85, (
        "polyformproject org licen[sc]es",
        "required notice copyright (?:[^ ]+ ){0,8}licen[sc]e",
    )),
    ("commons-clause", 0.9, (
        "commons clause (?:licen[sc]e )?(?:condition|restriction)",
        "the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software",
    )),
    ("hippocratic", 0.85, (
        "hippocratic licen[sc]e version (?:1|2|3)",
        "the software must not be used (?:by any person or entity )?for any systems activities or other uses that violate any human rights laws?",
    )),
    ("openrail", 0.9, (
        "(?:open ?rail|responsible ai licen[sc]e)(?: m| s| d)?",
        "bigscience (?:open ?rail m|rail) licen[sc]e",
        "creativeml open ?rail m(?: licen[sc]e)?",
    )),
    ("llama", 0.9, (
        "llama (?:[234](?: [0-9])? )?community licen[sc]e(?: agreement)?",
        "licen[sc]ed under the llama (?:[234](?: [0-9])? )?(?:community )?licen[sc]e",
    )),
    ("odbl", 0.9, (
        "(?:openstreetmap|this database) (?:[^ ]+ ){0,8}open database licen[sc]e",
        "opendatacommons org licen[sc]es (?:odbl|by|pddl)",
    )),
    ("ogl-uk", 0.9, (
        "contains public sector information licen[sc]ed under the open government licen[sc]e",
        "open government licen[sc]e(?: v(?:ersion)? ?[123](?: 0)?)?",
    )),
    ("etalab", 0.9, ("(?:licence ouverte|open licen[sc]e) (?:v(?:ersion)? ?)?(?:[12] 0 )?etalab",
                     "licence ouverte(?: version)?(?: [12] 0)?")),
    ("dl-de", 0.9, ("datenlizenz deutschland (?:namensnennung|zero) (?:version )?2 0",)),
    ("curl", 0.9, ("curl licen[sc]e", "copyright (?:c )?(?:[0-9]+ )*daniel stenberg")),
    ("imagemagick", 0.9, ("imagemagick licen[sc]e", "imagemagick org script licen[sc]e")),
    ("icu", 0.9, ("icu licen[sc]e", "unicode (?:licen[sc]e agreement|terms of use copyright)",
                  "copyright (?:c )?(?:[0-9]+ )*unicode inc all rights reserved")),
    ("tcl", 0.85, ("tcl(?: tk)? licen[sc]e", "this software is copyrighted by the regents of the university of california sun microsystems")),
    ("sleepycat", 0.9, ("sleepycat licen[sc]e",
                        "redistributions in any form must be accompanied by information on how to obtain complete source code")),
    ("bzip2", 0.85, ("bzip2 licen[sc]e", "copyright (?:c )?(?:[0-9]+ )*julian (?:r )?seward")),
    ("freetype", 0.85, ("freetype (?:project )?licen[sc]e",
                        "portions of this software are copyright (?:c )?(?:[0-9]+ )*the freetype project")),
    ("ijg", 0.85, ("independent jpeg group(?: s)? licen[sc]e",
                   "this software is based in part on the work of the independent jpeg group")),
    ("libtiff", 0.85, ("libtiff licen[sc]e", "copyright (?:c )?(?:[0-9]+ )*sam leffler")),
    ("xfree86", 0.85, ("xfree86 licen[sc]e(?: 1 1)?",)),
    ("naumen", 0.85, ("naumen public licen[sc]e",)),
    ("nasa", 0.85, ("nasa open source agreement(?: version)?(?: 1 3)?",)),
    ("intel", 0.85, ("intel (?:open source|simplified software) licen[sc]e",)),
    ("watcom", 0.85, ("(?:sybase )?open watcom public licen[sc]e",)),
    ("rpl", 0.85, ("reciprocal public licen[sc]e(?: 1 [15])?",)),
    ("parity", 0.85, ("parity public licen[sc]e",)),
    ("prosperity", 0.85, ("prosperity public licen[sc]e",)),
    ("blueoak", 0.9, ("blue oak model licen[sc]e",)),
    ("proprietary", 0.8, (
        "unauthorized copying of this file via any medium is strictly prohibited proprietary",
        "contains (?:trade secrets and )?proprietary information of",
        "may not be (?:copied|disclosed|reproduced) except (?:in accordance with|under) the terms of (?:that|the|a) (?:non ?disclosure|licen[sc]e) agreement",
        "may not be reproduced (?:stored )?(?:distributed )?(?:or transmitted )?(?:in any form )?without (?:the )?(?:prior )?(?:written )?permission",
        "end user licen[sc]e agreement",
        "licen[sc]ed for evaluation (?:purposes )?only",
        "for internal use only (?:all rights reserved|proprietary)",
    )),
    ("non-commercial", 0.7, (
        "licen[sc]ed for (?:personal|academic|research) (?:and )?non ?commercial use only",
        "non ?commercial (?:use only )?licen[sc]e",
        "for (?:academic|research) (?:and educational )?purposes only (?:[^ ]+ ){0,6}licen[sc]e",
    )),
    ("multiple", 0.6, (
        "licen[sc]ed under either of (?:the )?apache licen[sc]e",
        "dual licen[sc]ed (?:under )?(?:the )?(?:mit and|mit or|apache|gpl|mit gpl)",
        "(?:tri|triple) licen[sc]ed",
        "spdx licen[sc]e identifier (?:[a-z0-9]+ ){1,6}or (?:[a-z0-9]+ ?){1,4}",
        "spdx licen[sc]e identifier (?:[a-z0-9]+ ){1,6}and (?:[a-z0-9]+ ?){1,4}",
        "spdx licen[sc]e identifier (?:[a-z0-9]+ ){1,6}with (?:[a-z0-9]+ ?){1,4}exception",
    )),
    ("warranty", 0.3, (
        "without even the implied warranty of merchantability or fitness for a particular purpose",
        "there is no warranty for the program to the extent permitted by applicable law",
        "the entire risk as to the quality and performance of the program is with you",
        "without warranties or conditions of any kind either express or implied",
        "in no event (?:shall|will) (?:[^ ]+ ){1,10}be liable (?:[^ ]+ ){0,30}damages",
    )),
)
