"""The signature rules of the license scan, written out one by one: label, expression, a text that it is for.

Expressions are over words in lower case parted by one space; punctuation is gone ("GPL-3.0" reads "gpl 3 0"). Lists are in the
order of their priority: texts of the licenses themselves, machine-readable tags and stated choices of versions, names with a
version, names without one, and mere mentions. A rule's keywords are taken from its expression (licenses.py).
"""

from __future__ import annotations

#: Words of grants and conditions as they stand in the licenses' own texts and notices.
GRANTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", r"neither the names? of (?:\w+ ){1,12}may be used to endorse or promote products", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE."),
    ("apache-2.0", r"you may not use this file except in compliance with the license(?: you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0)?", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "This product includes software developed by the Apache Software Foundation"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", r"under the terms of the gnu affero general public license as published by the free software foundation", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("cc", r"this work is licensed under (?:a|the) creative commons", "This work is licensed under a Creative Commons licence"),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights to this work", "The author has waived all copyright and related or neighboring rights to this work"),
    ("beerware", r"if we meet some ?day and you think this stuff is worth it you can buy me a beer", "If we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("wtfpl", r"you just do what the fuck you want to", "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "The intent of this document is to state the conditions under which a Package may be copied"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("json", r"the software shall be used for good not evil", "The Software shall be used for Good, not Evil."),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("curl", r"except as contained in this notice the name of a copyright holder shall not be used in advertising", "Except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used", "Except as contained in this notice, the name of the X Consortium shall not be used"),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files"),
    ("ftl", r"portions of this software are copyright (?:\w+ ){0,6}the freetype project", "Portions of this software are copyright 2006 The FreeType Project"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", "If you make the functionality of the Program or a modified version available to third parties as a service"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "You may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work."),
    ("commons-clause", r"the license does not grant to you the right to sell the software", "the License does not grant to you, the right to Sell the Software"),
    ("odbl-1.0", r"this database is made available under the open database license", "This database is made available under the Open Database License"),
    ("blueoak-1.0.0", r"each contributor licenses you to do everything with this software that would otherwise infringe", "Each contributor licenses you to do everything with this software that would otherwise infringe"),
    ("upl-1.0", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", "Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software"),
]

#: Tags for machines, and stated choices between versions.
TAGS = [
    ("gpl-1.0-only", r"spdx license identifier gpl 1 0(?: only)?", "SPDX-License-Identifier: GPL-1.0-only"),
    ("gpl-1.0-or-later", r"spdx license identifier gpl 1 0 or later", "SPDX-License-Identifier: GPL-1.0-or-later"),
    ("gpl-2.0-only", r"spdx license identifier gpl 2 0(?: only)?", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-2.0-or-later", r"spdx license identifier gpl 2 0 or later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-3.0-only", r"spdx license identifier gpl 3 0(?: only)?", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3.0-or-later", r"spdx license identifier gpl 3 0 or later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl-2.0-only", r"spdx license identifier lgpl 2 0(?: only)?", "SPDX-License-Identifier: LGPL-2.0-only"),
    ("lgpl-2.0-or-later", r"spdx license identifier lgpl 2 0 or later", "SPDX-License-Identifier: LGPL-2.0-or-later"),
    ("lgpl-2.1-only", r"spdx license identifier lgpl 2 1(?: only)?", "SPDX-License-Identifier: LGPL-2.1"),
    ("lgpl-2.1-or-later", r"spdx license identifier lgpl 2 1 or later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl-3.0-only", r"spdx license identifier lgpl 3 0(?: only)?", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("lgpl-3.0-or-later", r"spdx license identifier lgpl 3 0 or later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("agpl-1.0-only", r"spdx license identifier agpl 1 0(?: only)?", "SPDX-License-Identifier: AGPL-1.0-only"),
    ("agpl-1.0-or-later", r"spdx license identifier agpl 1 0 or later", "SPDX-License-Identifier: AGPL-1.0-or-later"),
    ("agpl-3.0-only", r"spdx license identifier agpl 3 0(?: only)?", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl-3.0-or-later", r"spdx license identifier agpl 3 0 or later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("gfdl-1.1", r"spdx license identifier gfdl 1 1(?: only| or later)?", "SPDX-License-Identifier: GFDL-1.1-or-later"),
    ("gfdl-1.2", r"spdx license identifier gfdl 1 2(?: only| or later)?", "SPDX-License-Identifier: GFDL-1.2-only"),
    ("gfdl-1.3", r"spdx license identifier gfdl 1 3(?: only| or later)?", "SPDX-License-Identifier: GFDL-1.3"),
    ("apache-1.0", r"spdx license identifier apache 1 0", "SPDX-License-Identifier: Apache-1.0"),
    ("apache-1.1", r"spdx license identifier apache 1 1", "SPDX-License-Identifier: Apache-1.1"),
    ("apache-2.0", r"spdx license identifier apache 2 0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0-with-llvm-exception", r"spdx license identifier apache 2 0 with llvm exception", "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception"),
    ("gpl-2.0-with-classpath-exception", r"spdx license identifier gpl 2 0(?: only)? with classpath exception(?: 2 0)?", "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0"),
    ("gpl-2.0-with-linux-syscall-note", r"spdx license identifier gpl 2 0(?: only)? with linux syscall note", "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note"),
    ("gpl-3.0-with-gcc-exception", r"spdx license identifier gpl 3 0(?: or later)? with gcc exception 3 1", "SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1"),
    ("mit", r"spdx license identifier mit", "SPDX-License-Identifier: MIT"),
    ("mit-0", r"spdx license identifier mit 0", "SPDX-License-Identifier: MIT-0"),
    ("mit-or-apache-2.0", r"spdx license identifier (?:mit or apache 2 0|apache 2 0 or mit)", "SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("isc", r"spdx license identifier isc", "SPDX-License-Identifier: ISC"),
    ("0bsd", r"spdx license identifier 0bsd", "SPDX-License-Identifier: 0BSD"),
    ("bsd-1-clause", r"spdx license identifier bsd 1 clause", "SPDX-License-Identifier: BSD-1-Clause"),
    ("bsd-2-clause", r"spdx license identifier bsd 2 clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-2-clause-patent", r"spdx license identifier bsd 2 clause patent", "SPDX-License-Identifier: BSD-2-Clause-Patent"),
    ("bsd-3-clause", r"spdx license identifier bsd 3 clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-3-clause-clear", r"spdx license identifier bsd 3 clause clear", "SPDX-License-Identifier: BSD-3-Clause-Clear"),
    ("bsd-4-clause", r"spdx license identifier bsd 4 clause", "SPDX-License-Identifier: BSD-4-Clause"),
    ("mpl-1.0", r"spdx license identifier mpl 1 0", "SPDX-License-Identifier: MPL-1.0"),
    ("mpl-1.1", r"spdx license identifier mpl 1 1", "SPDX-License-Identifier: MPL-1.1"),
    ("mpl-2.0", r"spdx license identifier mpl 2 0", "SPDX-License-Identifier: MPL-2.0"),
    ("epl-1.0", r"spdx license identifier epl 1 0", "SPDX-License-Identifier: EPL-1.0"),
    ("epl-2.0", r"spdx license identifier epl 2 0", "SPDX-License-Identifier: EPL-2.0"),
    ("cddl-1.0", r"spdx license identifier cddl 1 0", "SPDX-License-Identifier: CDDL-1.0"),
    ("cddl-1.1", r"spdx license identifier cddl 1 1", "SPDX-License-Identifier: CDDL-1.1"),
    ("eupl-1.1", r"spdx license identifier eupl 1 1", "SPDX-License-Identifier: EUPL-1.1"),
    ("eupl-1.2", r"spdx license identifier eupl 1 2", "SPDX-License-Identifier: EUPL-1.2"),
    ("afl-2.1", r"spdx license identifier afl 2 1", "SPDX-License-Identifier: AFL-2.1"),
    ("afl-3.0", r"spdx license identifier afl 3 0", "SPDX-License-Identifier: AFL-3.0"),
    ("osl-2.1", r"spdx license identifier osl 2 1", "SPDX-License-Identifier: OSL-2.1"),
    ("osl-3.0", r"spdx license identifier osl 3 0", "SPDX-License-Identifier: OSL-3.0"),
    ("artistic-1.0", r"spdx license identifier artistic 1 0(?: perl| cl8)?", "SPDX-License-Identifier: Artistic-1.0-Perl"),
    ("artistic-2.0", r"spdx license identifier artistic 2 0", "SPDX-License-Identifier: Artistic-2.0"),
    ("bsl-1.0", r"spdx license identifier bsl 1 0", "SPDX-License-Identifier: BSL-1.0"),
    ("busl-1.1", r"spdx license identifier busl 1 1", "SPDX-License-Identifier: BUSL-1.1"),
    ("ofl-1.0", r"spdx license identifier ofl 1 0", "SPDX-License-Identifier: OFL-1.0"),
    ("ofl-1.1", r"spdx license identifier ofl 1 1", "SPDX-License-Identifier: OFL-1.1"),
    ("ecl-2.0", r"spdx license identifier ecl 2 0", "SPDX-License-Identifier: ECL-2.0"),
    ("cpl-1.0", r"spdx license identifier cpl 1 0", "SPDX-License-Identifier: CPL-1.0"),
    ("ipl-1.0", r"spdx license identifier ipl 1 0", "SPDX-License-Identifier: IPL-1.0"),
    ("lppl-1.3c", r"spdx license identifier lppl 1 3c", "SPDX-License-Identifier: LPPL-1.3c"),
    ("odbl-1.0", r"spdx license identifier odbl 1 0", "SPDX-License-Identifier: ODbL-1.0"),
    ("odc-by-1.0", r"spdx license identifier odc by 1 0", "SPDX-License-Identifier: ODC-By-1.0"),
    ("pddl-1.0", r"spdx license identifier pddl 1 0", "SPDX-License-Identifier: PDDL-1.0"),
    ("cc0-1.0", r"spdx license identifier cc0 1 0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by-2.0", r"spdx license identifier cc by 2 0", "SPDX-License-Identifier: CC-BY-2.0"),
    ("cc-by-3.0", r"spdx license identifier cc by 3 0", "SPDX-License-Identifier: CC-BY-3.0"),
    ("cc-by-4.0", r"spdx license identifier cc by 4 0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc-by-sa-3.0", r"spdx license identifier cc by sa 3 0", "SPDX-License-Identifier: CC-BY-SA-3.0"),
    ("cc-by-sa-4.0", r"spdx license identifier cc by sa 4 0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("cc-by-nc-4.0", r"spdx license identifier cc by nc 4 0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("cc-by-nd-4.0", r"spdx license identifier cc by nd 4 0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("cc-by-nc-sa-4.0", r"spdx license identifier cc by nc sa 4 0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    ("cc-by-nc-nd-4.0", r"spdx license identifier cc by nc nd 4 0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    ("zlib", r"spdx license identifier zlib", "SPDX-License-Identifier: Zlib"),
    ("unlicense", r"spdx license identifier unlicense", "SPDX-License-Identifier: Unlicense"),
    ("wtfpl", r"spdx license identifier wtfpl", "SPDX-License-Identifier: WTFPL"),
    ("postgresql", r"spdx license identifier postgresql", "SPDX-License-Identifier: PostgreSQL"),
    ("ncsa", r"spdx license identifier ncsa", "SPDX-License-Identifier: NCSA"),
    ("ms-pl", r"spdx license identifier ms pl", "SPDX-License-Identifier: MS-PL"),
    ("ms-rl", r"spdx license identifier ms rl", "SPDX-License-Identifier: MS-RL"),
    ("vim", r"spdx license identifier vim", "SPDX-License-Identifier: Vim"),
    ("ruby", r"spdx license identifier ruby", "SPDX-License-Identifier: Ruby"),
    ("curl", r"spdx license identifier curl", "SPDX-License-Identifier: curl"),
    ("openssl", r"spdx license identifier openssl", "SPDX-License-Identifier: OpenSSL"),
    ("ftl", r"spdx license identifier ftl", "SPDX-License-Identifier: FTL"),
    ("ijg", r"spdx license identifier ijg", "SPDX-License-Identifier: IJG"),
    ("hpnd", r"spdx license identifier hpnd", "SPDX-License-Identifier: HPND"),
    ("psf-2.0", r"spdx license identifier psf 2 0", "SPDX-License-Identifier: PSF-2.0"),
    ("python-2.0", r"spdx license identifier python 2 0(?: 1)?", "SPDX-License-Identifier: Python-2.0.1"),
    ("php-3.01", r"spdx license identifier php 3 01", "SPDX-License-Identifier: PHP-3.01"),
    ("zpl-2.1", r"spdx license identifier zpl 2 1", "SPDX-License-Identifier: ZPL-2.1"),
    ("upl-1.0", r"spdx license identifier upl 1 0", "SPDX-License-Identifier: UPL-1.0"),
    ("sspl-1.0", r"spdx license identifier sspl 1 0", "SPDX-License-Identifier: SSPL-1.0"),
    ("elastic-2.0", r"spdx license identifier elastic 2 0", "SPDX-License-Identifier: Elastic-2.0"),
    ("mulan-psl-2.0", r"spdx license identifier mulanpsl 2 0", "SPDX-License-Identifier: MulanPSL-2.0"),
    ("blueoak-1.0.0", r"spdx license identifier blueoak 1 0 0", "SPDX-License-Identifier: BlueOak-1.0.0"),
    ("cecill-2.1", r"spdx license identifier cecill 2 1", "SPDX-License-Identifier: CECILL-2.1"),
    ("cdla-permissive-1.0", r"spdx license identifier cdla permissive 1 0", "SPDX-License-Identifier: CDLA-Permissive-1.0"),
    ("cdla-permissive-2.0", r"spdx license identifier cdla permissive 2 0", "SPDX-License-Identifier: CDLA-Permissive-2.0"),
    ("cdla-sharing-1.0", r"spdx license identifier cdla sharing 1 0", "SPDX-License-Identifier: CDLA-Sharing-1.0"),
    ("polyform-noncommercial-1.0.0", r"spdx license identifier polyform noncommercial 1 0 0", "SPDX-License-Identifier: PolyForm-Noncommercial-1.0.0"),
    ("polyform-small-business-1.0.0", r"spdx license identifier polyform small business 1 0 0", "SPDX-License-Identifier: PolyForm-Small-Business-1.0.0"),
    ("gpl-1.0-or-later", r"(?:gnu general public license|(?:gnu )?gpl) (?:version |v ?)?1(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "GNU General Public License version 1 or (at your option) any later version"),
    ("gpl-2.0-or-later", r"(?:gnu general public license|(?:gnu )?gpl) (?:version |v ?)?2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "GNU General Public License, version 2 or later"),
    ("gpl-3.0-or-later", r"(?:gnu general public license|(?:gnu )?gpl) (?:version |v ?)?3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "GPL v3 or any later version"),
    ("gpl-2.0-or-later", r"either version 2 of the license or at your option any later version", "either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0-or-later", r"either version 3 of the license or at your option any later version", "either version 3 of the License, or (at your option) any later version"),
    ("lgpl-2.1-or-later", r"either version 2 1 of the license or at your option any later version", "either version 2.1 of the License, or (at your option) any later version"),
    ("gpl-2.0-only", r"(?:gnu general public license|(?:gnu )?gpl) (?:version |v ?)?2(?: 0)? only", "GPL v2 only"),
    ("gpl-3.0-only", r"(?:gnu general public license|(?:gnu )?gpl) (?:version |v ?)?3(?: 0)? only", "GNU GPL version 3 only"),
    ("lgpl-2.0-or-later", r"(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl) (?:version |v ?)?2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "GNU Library General Public License version 2 or later"),
    ("lgpl-2.1-or-later", r"(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl) (?:version |v ?)?2 1 or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "GNU Lesser General Public License v2.1 or (at your option) any later version"),
    ("lgpl-3.0-or-later", r"(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl) (?:version |v ?)?3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "LGPL v3 or later"),
    ("lgpl-2.1-only", r"(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl) (?:version |v ?)?2 1 only", "LGPL 2.1 only"),
    ("lgpl-3.0-only", r"(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl) (?:version |v ?)?3(?: 0)? only", "LGPL version 3 only"),
    ("agpl-3.0-or-later", r"(?:(?:gnu )?affero general public license|(?:gnu )?agpl) (?:version |v ?)?3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "GNU Affero General Public License version 3 or any later version"),
    ("agpl-3.0-only", r"(?:(?:gnu )?affero general public license|(?:gnu )?agpl) (?:version |v ?)?3(?: 0)? only", "AGPL v3 only"),
    ("gfdl-1.2-or-later", r"(?:gnu free documentation license|(?:gnu )?g?fdl) (?:version |v ?)?1 2 or (?:any )?later(?: version)?", "GNU Free Documentation License, Version 1.2 or any later version"),
    ("gfdl-1.3-or-later", r"(?:gnu free documentation license|(?:gnu )?g?fdl) (?:version |v ?)?1 3 or (?:any )?later(?: version)?", "GNU Free Documentation License, Version 1.3 or any later version"),
    ("gpl-2.0-or-later", r"gplv?2 or later", "GPLv2 or later"),
    ("gpl-3.0-or-later", r"gplv?3 or later", "GPLv3 or later"),
    ("lgpl-2.1-or-later", r"lgplv?2 1 or later", "LGPLv2.1 or later"),
    ("lgpl-3.0-or-later", r"lgplv?3 or later", "LGPLv3 or later"),
    ("agpl-3.0-or-later", r"agplv?3 or later", "AGPLv3 or later"),
    ("mit-or-apache-2.0", r"dual licensed under (?:the )?(?:mit and apache|apache and mit|mit or apache)(?: 2 0)?", "dual-licensed under MIT and Apache 2.0"),
    ("gpl-2.0", r"license gpl v2", "MODULE_LICENSE(\"GPL v2\")"),
    ("mit", r"osi approved mit license", "License :: OSI Approved :: MIT License"),
    ("bsd", r"osi approved bsd license", "License :: OSI Approved :: BSD License"),
    ("apache", r"osi approved apache software license", "License :: OSI Approved :: Apache Software License"),
    ("isc", r"osi approved isc license", "License :: OSI Approved :: ISC License (ISCL)"),
    ("gpl-2.0", r"osi approved gnu general public license v2(?: gplv2)?", "License :: OSI Approved :: GNU General Public License v2 (GPLv2)"),
    ("gpl-3.0", r"osi approved gnu general public license v3(?: gplv3)?", "License :: OSI Approved :: GNU General Public License v3 (GPLv3)"),
    ("mpl-2.0", r"osi approved mozilla public license 2 0(?: mpl 2 0)?", "License :: OSI Approved :: Mozilla Public License 2.0 (MPL 2.0)"),
    ("psf", r"osi approved python software foundation license", "License :: OSI Approved :: Python Software Foundation License"),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0", "https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0", "https://creativecommons.org/licenses/by/3.0/"),
    ("cc-by-2.5", r"creativecommons org licenses by 2 5", "https://creativecommons.org/licenses/by/2.5/"),
    ("cc-by-2.0", r"creativecommons org licenses by 2 0", "https://creativecommons.org/licenses/by/2.0/"),
    ("cc-by-sa-4.0", r"creativecommons org licenses by sa 4 0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by-sa-3.0", r"creativecommons org licenses by sa 3 0", "https://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc-by-sa-2.5", r"creativecommons org licenses by sa 2 5", "https://creativecommons.org/licenses/by-sa/2.5/"),
    ("cc-by-sa-2.0", r"creativecommons org licenses by sa 2 0", "https://creativecommons.org/licenses/by-sa/2.0/"),
    ("cc-by-nc-4.0", r"creativecommons org licenses by nc 4 0", "https://creativecommons.org/licenses/by-nc/4.0/"),
    ("cc-by-nc-3.0", r"creativecommons org licenses by nc 3 0", "https://creativecommons.org/licenses/by-nc/3.0/"),
    ("cc-by-nc-2.0", r"creativecommons org licenses by nc 2 0", "https://creativecommons.org/licenses/by-nc/2.0/"),
    ("cc-by-nd-4.0", r"creativecommons org licenses by nd 4 0", "https://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by-nd-3.0", r"creativecommons org licenses by nd 3 0", "https://creativecommons.org/licenses/by-nd/3.0/"),
    ("cc-by-nc-sa-4.0", r"creativecommons org licenses by nc sa 4 0", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc-sa-3.0", r"creativecommons org licenses by nc sa 3 0", "https://creativecommons.org/licenses/by-nc-sa/3.0/"),
    ("cc-by-nc-sa-2.0", r"creativecommons org licenses by nc sa 2 0", "https://creativecommons.org/licenses/by-nc-sa/2.0/"),
    ("cc-by-nc-nd-4.0", r"creativecommons org licenses by nc nd 4 0", "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("cc-by-nc-nd-3.0", r"creativecommons org licenses by nc nd 3 0", "https://creativecommons.org/licenses/by-nc-nd/3.0/"),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("pdm-1.0", r"creativecommons org publicdomain mark 1 0", "https://creativecommons.org/publicdomain/mark/1.0/"),
    ("apache-2.0", r"apache org licenses license 2 0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", r"gnu org licenses (?:old licenses )?gpl 2 0", "https://www.gnu.org/licenses/old-licenses/gpl-2.0.html"),
    ("gpl-3.0", r"gnu org licenses gpl 3 0", "https://www.gnu.org/licenses/gpl-3.0.html"),
    ("lgpl-2.1", r"gnu org licenses (?:old licenses )?lgpl 2 1", "https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html"),
    ("lgpl-3.0", r"gnu org licenses lgpl 3 0", "https://www.gnu.org/licenses/lgpl-3.0.html"),
    ("agpl-3.0", r"gnu org licenses agpl 3 0", "https://www.gnu.org/licenses/agpl-3.0.html"),
    ("gfdl-1.3", r"gnu org licenses fdl 1 3", "https://www.gnu.org/licenses/fdl-1.3.html"),
    ("mit", r"opensource org licenses? mit", "https://opensource.org/licenses/MIT"),
    ("bsd-2-clause", r"opensource org licenses? bsd 2 clause", "https://opensource.org/licenses/BSD-2-Clause"),
    ("bsd-3-clause", r"opensource org licenses? bsd 3 clause", "https://opensource.org/licenses/BSD-3-Clause"),
    ("isc", r"opensource org licenses? isc", "https://opensource.org/licenses/ISC"),
    ("apache-2.0", r"opensource org licenses? apache 2 0", "https://opensource.org/licenses/Apache-2.0"),
    ("mpl-2.0", r"mozilla org mpl 2 0", "http://mozilla.org/MPL/2.0/"),
    ("mpl-1.1", r"mozilla org mpl (?:mpl )?1 1", "http://www.mozilla.org/MPL/1.1/"),
    ("epl-2.0", r"eclipse org legal epl 2 0", "https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1.0", r"eclipse org legal epl v10", "http://www.eclipse.org/legal/epl-v10.html"),
    ("bsl-1.0", r"boost org license 1 0", "http://www.boost.org/LICENSE_1_0.txt"),
    ("ofl-1.1", r"scripts sil org ofl", "https://scripts.sil.org/OFL"),
    ("odbl-1.0", r"opendatacommons org licenses odbl(?: 1 0)?", "https://opendatacommons.org/licenses/odbl/1-0/"),
    ("odc-by-1.0", r"opendatacommons org licenses by(?: 1 0)?", "https://opendatacommons.org/licenses/by/1-0/"),
    ("pddl-1.0", r"opendatacommons org licenses pddl(?: 1 0)?", "https://opendatacommons.org/licenses/pddl/1-0/"),
    ("wtfpl", r"wtfpl net", "http://www.wtfpl.net/"),
]

#: Names with a version.
VERSIONS = [
    ("gpl-1.0", r"gnu general public license (?:version |v ?)?1(?: 0)?", "GNU General Public License version 1"),
    ("gpl-2.0", r"gnu general public license (?:version |v ?)?2(?: 0)?", "GNU General Public License, version 2"),
    ("gpl-3.0", r"gnu general public license (?:version |v ?)?3(?: 0)?", "GNU General Public License v3.0"),
    ("gpl-1.0", r"(?:gnu )?gpl ?(?:version |v ?)?1(?: 0)?", "GPLv1"),
    ("gpl-2.0", r"(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?", "GPLv2"),
    ("gpl-3.0", r"(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?", "GNU GPL 3.0"),
    ("lgpl-2.0", r"gnu (?:lesser|library) general public license (?:version |v ?)?2(?: 0)?", "GNU Library General Public License version 2"),
    ("lgpl-2.1", r"gnu (?:lesser|library) general public license (?:version |v ?)?2 1", "GNU Lesser General Public License version 2.1"),
    ("lgpl-3.0", r"gnu (?:lesser|library) general public license (?:version |v ?)?3(?: 0)?", "GNU Lesser General Public License, Version 3"),
    ("lgpl-2.0", r"(?:gnu )?lgpl ?(?:version |v ?)?2(?: 0)?", "LGPLv2"),
    ("lgpl-2.1", r"(?:gnu )?lgpl ?(?:version |v ?)?2 1", "LGPL-2.1"),
    ("lgpl-3.0", r"(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?", "LGPL v3"),
    ("agpl-1.0", r"affero general public license (?:version |v ?)?1(?: 0)?", "Affero General Public License version 1"),
    ("agpl-3.0", r"(?:gnu )?affero general public license (?:version |v ?)?3(?: 0)?", "GNU Affero General Public License v3"),
    ("agpl-3.0", r"(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?", "AGPLv3"),
    ("gfdl-1.1", r"(?:gnu free documentation license|(?:gnu )?gfdl) (?:version |v ?)?1 1", "GNU Free Documentation License, Version 1.1"),
    ("gfdl-1.2", r"(?:gnu free documentation license|(?:gnu )?gfdl) (?:version |v ?)?1 2", "GFDL 1.2"),
    ("gfdl-1.3", r"(?:gnu free documentation license|(?:gnu )?gfdl) (?:version |v ?)?1 3", "GNU Free Documentation License version 1.3"),
    ("apache-1.0", r"apache (?:software )?license (?:version |v ?)?1(?: 0)?", "Apache License 1.0"),
    ("apache-1.1", r"apache (?:software )?license (?:version |v ?)?1 1", "Apache Software License, Version 1.1"),
    ("apache-2.0", r"apache (?:software )?license (?:version |v ?)?2(?: 0)?", "Apache License, Version 2.0"),
    ("apache-2.0", r"apache ?(?:version |v ?)?2 0", "Apache-2.0"),
    ("apache-2.0", r"apachev?2", "ApacheV2"),
    ("apache-2.0", r"asl (?:version |v ?)?2(?: 0)?", "ASL 2.0"),
    ("apache-2.0", r"al ?2 0 licen[cs]e", "AL2.0 license"),
    ("mpl-1.0", r"mozilla public license (?:version |v ?)?1(?: 0)?", "Mozilla Public License 1.0"),
    ("mpl-1.1", r"mozilla public license (?:version |v ?)?1 1", "Mozilla Public License Version 1.1"),
    ("mpl-2.0", r"mozilla public license (?:version |v ?)?2(?: 0)?", "Mozilla Public License, v. 2.0"),
    ("mpl-1.0", r"mpl ?(?:version |v ?)?1 0", "MPL 1.0"),
    ("mpl-1.1", r"mpl ?(?:version |v ?)?1 1", "MPL-1.1"),
    ("mpl-2.0", r"mpl ?(?:version |v ?)?2(?: 0)?", "MPLv2"),
    ("npl-1.0", r"netscape public license (?:version |v ?)?1(?: 0)?", "Netscape Public License version 1.0"),
    ("npl-1.1", r"netscape public license (?:version |v ?)?1 1", "Netscape Public License version 1.1"),
    ("epl-1.0", r"eclipse public license (?:version |v ?)?1(?: 0)?", "Eclipse Public License - v 1.0"),
    ("epl-2.0", r"eclipse public license (?:version |v ?)?2(?: 0)?", "Eclipse Public License 2.0"),
    ("epl-1.0", r"epl ?(?:version |v ?)?1 0", "EPL-1.0"),
    ("epl-2.0", r"epl ?(?:version |v ?)?2 0", "EPL 2.0"),
    ("edl-1.0", r"eclipse distribution license (?:version |v ?)?1(?: 0)?", "Eclipse Distribution License v1.0"),
    ("cddl-1.0", r"(?:common development and distribution license|cddl) (?:version |v ?)?1(?: 0)?", "Common Development and Distribution License (CDDL) Version 1.0"),
    ("cddl-1.1", r"(?:common development and distribution license|cddl) (?:version |v ?)?1 1", "CDDL 1.1"),
    ("eupl-1.0", r"(?:european union public licen[cs]e|eupl) (?:version |v ?)?1(?: 0)?", "European Union Public Licence 1.0"),
    ("eupl-1.1", r"(?:european union public licen[cs]e|eupl) (?:version |v ?)?1 1", "European Union Public Licence v1.1"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl) (?:version |v ?)?1 2", "EUPL 1.2"),
    ("afl-1.1", r"(?:academic free license|afl) (?:version |v ?)?1 1", "Academic Free License 1.1"),
    ("afl-1.2", r"(?:academic free license|afl) (?:version |v ?)?1 2", "Academic Free License 1.2"),
    ("afl-2.0", r"(?:academic free license|afl) (?:version |v ?)?2(?: 0)?", "Academic Free License 2.0"),
    ("afl-2.1", r"(?:academic free license|afl) (?:version |v ?)?2 1", "Academic Free License v. 2.1"),
    ("afl-3.0", r"(?:academic free license|afl) (?:version |v ?)?3(?: 0)?", "Academic Free License (\"AFL\") v. 3.0"),
    ("osl-1.0", r"(?:open software license|osl) (?:version |v ?)?1(?: 0)?", "Open Software License 1.0"),
    ("osl-2.0", r"(?:open software license|osl) (?:version |v ?)?2(?: 0)?", "Open Software License v2.0"),
    ("osl-2.1", r"(?:open software license|osl) (?:version |v ?)?2 1", "Open Software License 2.1"),
    ("osl-3.0", r"(?:open software license|osl) (?:version |v ?)?3(?: 0)?", "OSL 3.0"),
    ("artistic-1.0", r"artistic(?: license)? (?:version |v ?)?1(?: 0)?", "Artistic License 1.0"),
    ("artistic-2.0", r"artistic(?: license)? (?:version |v ?)?2(?: 0)?", "Artistic License 2.0"),
    ("bsl-1.0", r"boost software license (?:version |v ?)?1(?: 0)?", "Boost Software License - Version 1.0"),
    ("bsl-1.0", r"bsl (?:version |v ?)?1 0", "BSL-1.0"),
    ("busl-1.1", r"business source license (?:version |v ?)?1 1", "Business Source License 1.1"),
    ("busl-1.1", r"busl (?:version |v ?)?1 1|bsl (?:version |v ?)?1 1", "BSL 1.1"),
    ("ofl-1.0", r"open font license (?:version |v ?)?1(?: 0)?", "Open Font License 1.0"),
    ("ofl-1.1", r"(?:sil )?open font license (?:version |v ?)?1 1", "SIL Open Font License 1.1"),
    ("ofl-1.1", r"(?:sil )?ofl ?(?:version |v ?)?1 1", "OFL-1.1"),
    ("ecl-1.0", r"educational community license (?:version |v ?)?1(?: 0)?", "Educational Community License version 1.0"),
    ("ecl-2.0", r"educational community license (?:version |v ?)?2(?: 0)?", "Educational Community License, Version 2.0"),
    ("cpl-1.0", r"common public license (?:version |v ?)?1(?: 0)?", "Common Public License Version 1.0"),
    ("ipl-1.0", r"ibm public license (?:version |v ?)?1(?: 0)?", "IBM Public License Version 1.0"),
    ("cpal-1.0", r"common public attribution license (?:version |v ?)?1(?: 0)?", "Common Public Attribution License Version 1.0"),
    ("lppl-1.0", r"latex project public license (?:version |v ?)?1(?: 0)?", "LaTeX Project Public License 1.0"),
    ("lppl-1.2", r"latex project public license (?:version |v ?)?1 2", "LaTeX Project Public License 1.2"),
    ("lppl-1.3", r"latex project public license (?:version |v ?)?1 3[ac]?", "LaTeX Project Public License, version 1.3c"),
    ("lppl-1.3", r"lppl (?:version |v ?)?1 3[ac]?", "LPPL 1.3c"),
    ("odbl-1.0", r"(?:open (?:data commons open )?database license|odbl) (?:version |v ?)?1(?: 0)?", "Open Database License v1.0"),
    ("odc-by-1.0", r"(?:open data commons attribution license|odc by) (?:version |v ?)?1(?: 0)?", "Open Data Commons Attribution License v1.0"),
    ("pddl-1.0", r"(?:public domain dedication and license|pddl) (?:version |v ?)?1(?: 0)?", "Public Domain Dedication and License v1.0"),
    ("qpl-1.0", r"q public license (?:version |v ?)?1(?: 0)?", "Q Public License Version 1.0"),
    ("cecill-1.0", r"cecill(?: free software license)?(?: agreement)? (?:version |v ?)?1(?: 0)?", "CeCILL 1.0"),
    ("cecill-2.0", r"cecill(?: free software license)?(?: agreement)? (?:version |v ?)?2(?: 0)?", "CeCILL v2.0"),
    ("cecill-2.1", r"cecill(?: free software license)?(?: agreement)? (?:version |v ?)?2 1", "CeCILL Free Software License Agreement v2.1"),
    ("cecill-b", r"cecill b", "CeCILL-B"),
    ("cecill-c", r"cecill c", "CeCILL-C"),
    ("zpl-1.1", r"(?:zope public license|zpl) (?:version |v ?)?1 1", "Zope Public License 1.1"),
    ("zpl-2.0", r"(?:zope public license|zpl) (?:version |v ?)?2(?: 0)?", "Zope Public License 2.0"),
    ("zpl-2.1", r"(?:zope public license|zpl) (?:version |v ?)?2 1", "Zope Public License (ZPL) Version 2.1"),
    ("php-3.0", r"php license (?:version |v ?)?3(?: 0)?", "PHP License, version 3.0"),
    ("php-3.01", r"php license (?:version |v ?)?3 01", "PHP License, version 3.01"),
    ("psf-2.0", r"(?:python software foundation license|psf license) (?:version |v ?)?2(?: 0)?", "Python Software Foundation License Version 2"),
    ("python-2.0", r"python license (?:version |v ?)?2(?: 0)?", "Python License 2.0"),
    ("apsl-1.0", r"(?:apple public source license|apsl) (?:version |v ?)?1(?: 0)?", "Apple Public Source License 1.0"),
    ("apsl-1.2", r"(?:apple public source license|apsl) (?:version |v ?)?1 2", "Apple Public Source License 1.2"),
    ("apsl-2.0", r"(?:apple public source license|apsl) (?:version |v ?)?2(?: 0)?", "Apple Public Source License Version 2.0"),
    ("rpl-1.1", r"reciprocal public license (?:version |v ?)?1 1", "Reciprocal Public License 1.1"),
    ("rpl-1.5", r"reciprocal public license (?:version |v ?)?1 5", "Reciprocal Public License 1.5"),
    ("sspl-1.0", r"(?:server side public license|sspl) (?:version |v ?)?1(?: 0)?", "Server Side Public License, version 1"),
    ("upl-1.0", r"universal permissive license (?:version |v ?)?1(?: 0)?", "Universal Permissive License v1.0"),
    ("mulan-psl-1.0", r"mulan (?:permissive software license|psl) (?:version |v ?)?1(?: 0)?", "Mulan PSL v1"),
    ("mulan-psl-2.0", r"mulan (?:permissive software license|psl) (?:version |v ?)?2(?: 0)?", "Mulan Permissive Software License, Version 2"),
    ("ogl-uk-1.0", r"open government licen[cs]e (?:version |v ?)?1(?: 0)?", "Open Government Licence v1.0"),
    ("ogl-uk-2.0", r"open government licen[cs]e (?:version |v ?)?2(?: 0)?", "Open Government Licence v2.0"),
    ("ogl-uk-3.0", r"open government licen[cs]e (?:version |v ?)?3(?: 0)?", "Open Government Licence v3.0"),
    ("polyform-noncommercial-1.0.0", r"polyform noncommercial license (?:version |v ?)?1 0(?: 0)?", "PolyForm Noncommercial License 1.0.0"),
    ("polyform-shield-1.0.0", r"polyform shield license (?:version |v ?)?1 0(?: 0)?", "PolyForm Shield License 1.0.0"),
    ("polyform-small-business-1.0.0", r"polyform small business license (?:version |v ?)?1 0(?: 0)?", "PolyForm Small Business License 1.0.0"),
    ("blueoak-1.0.0", r"blue oak model license (?:version |v ?)?1 0(?: 0)?", "Blue Oak Model License 1.0.0"),
    ("elastic-2.0", r"elastic license (?:version |v ?)?2(?: 0)?", "Elastic License 2.0"),
    ("bigscience-rail-1.0", r"bigscience (?:bloom )?rail(?: license)? (?:version |v ?)?1(?: 0)?", "BigScience RAIL License v1.0"),
    ("bigcode-openrail-m-1.0", r"bigcode open ?rail m(?: license)? (?:version |v ?)?1(?: 0)?", "BigCode OpenRAIL-M v1"),
    ("creativeml-openrail-m", r"creativeml open ?rail(?: m| m license)?", "CreativeML Open RAIL-M"),
    ("cdla-permissive-1.0", r"(?:community data license agreement|cdla) permissive (?:version |v ?)?1(?: 0)?", "Community Data License Agreement - Permissive - Version 1.0"),
    ("cdla-permissive-2.0", r"(?:community data license agreement|cdla) permissive (?:version |v ?)?2(?: 0)?", "CDLA-Permissive-2.0"),
    ("cdla-sharing-1.0", r"(?:community data license agreement|cdla) sharing (?:version |v ?)?1(?: 0)?", "CDLA Sharing 1.0"),
    ("bsd-1-clause", r"bsd 1 clause(?: license)?|1 clause bsd(?: license)?", "BSD 1-Clause License"),
    ("bsd-2-clause", r"bsd 2 clause(?: license)?|2 clause bsd(?: license)?", "the 2-clause BSD license"),
    ("bsd-2-clause", r"simplified bsd license|freebsd license", "Simplified BSD License"),
    ("bsd-3-clause", r"bsd 3 clause(?: license)?|3 clause bsd(?: license)?", "the 3-Clause BSD License"),
    ("bsd-3-clause", r"new bsd license|modified bsd license|revised bsd license", "Modified BSD License"),
    ("bsd-4-clause", r"bsd 4 clause(?: license)?|4 clause bsd(?: license)?|original bsd license", "the original BSD license"),
    ("0bsd", r"0bsd|bsd zero clause license|zero clause bsd(?: license)?", "BSD Zero Clause License"),
    ("mit-0", r"mit no attribution(?: license)?|mit 0(?: license)?", "MIT No Attribution"),
    ("llama", r"llama (?:2 |3 |3 1 |3 2 |3 3 |4 )?community license(?: agreement)?", "Llama 3.1 Community License Agreement"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", "CC0 1.0 Universal"),
    ("cc0-1.0", r"creative commons zero(?: v1 0)?(?: universal)?", "Creative Commons Zero v1.0 Universal"),
    ("cc-by-1.0", r"cc by (?:version |v ?)?1(?: 0)?", "CC BY 1.0"),
    ("cc-by-2.0", r"cc by (?:version |v ?)?2(?: 0)?", "CC BY 2.0"),
    ("cc-by-2.5", r"cc by (?:version |v ?)?2 5", "CC BY 2.5"),
    ("cc-by-3.0", r"cc by (?:version |v ?)?3(?: 0)?", "CC-BY-3.0"),
    ("cc-by-4.0", r"cc by (?:version |v ?)?4(?: 0)?", "CC BY 4.0"),
    ("cc-by-sa-1.0", r"cc by sa (?:version |v ?)?1(?: 0)?", "CC BY-SA 1.0"),
    ("cc-by-sa-2.0", r"cc by sa (?:version |v ?)?2(?: 0)?", "CC BY-SA 2.0"),
    ("cc-by-sa-2.5", r"cc by sa (?:version |v ?)?2 5", "CC BY-SA 2.5"),
    ("cc-by-sa-3.0", r"cc by sa (?:version |v ?)?3(?: 0)?", "CC BY-SA 3.0"),
    ("cc-by-sa-4.0", r"cc by sa (?:version |v ?)?4(?: 0)?", "CC-BY-SA-4.0"),
    ("cc-by-nc-2.0", r"cc by nc (?:version |v ?)?2(?: 0)?", "CC BY-NC 2.0"),
    ("cc-by-nc-3.0", r"cc by nc (?:version |v ?)?3(?: 0)?", "CC BY-NC 3.0"),
    ("cc-by-nc-4.0", r"cc by nc (?:version |v ?)?4(?: 0)?", "CC BY-NC 4.0"),
    ("cc-by-nd-2.0", r"cc by nd (?:version |v ?)?2(?: 0)?", "CC BY-ND 2.0"),
    ("cc-by-nd-3.0", r"cc by nd (?:version |v ?)?3(?: 0)?", "CC BY-ND 3.0"),
    ("cc-by-nd-4.0", r"cc by nd (?:version |v ?)?4(?: 0)?", "CC BY-ND 4.0"),
    ("cc-by-nc-sa-2.0", r"cc by nc sa (?:version |v ?)?2(?: 0)?", "CC BY-NC-SA 2.0"),
    ("cc-by-nc-sa-3.0", r"cc by nc sa (?:version |v ?)?3(?: 0)?", "CC BY-NC-SA 3.0"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa (?:version |v ?)?4(?: 0)?", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-2.0", r"cc by nc nd (?:version |v ?)?2(?: 0)?", "CC BY-NC-ND 2.0"),
    ("cc-by-nc-nd-3.0", r"cc by nc nd (?:version |v ?)?3(?: 0)?", "CC BY-NC-ND 3.0"),
    ("cc-by-nc-nd-4.0", r"cc by nc nd (?:version |v ?)?4(?: 0)?", "CC BY-NC-ND 4.0"),
    ("cc-by-1.0", r"creative commons attribution 1(?: 0)?(?: (?:generic|unported))?", "Creative Commons Attribution 1.0 Generic"),
    ("cc-by-2.0", r"creative commons attribution 2(?: 0)?(?: (?:generic|unported))?", "Creative Commons Attribution 2.0 Generic"),
    ("cc-by-2.5", r"creative commons attribution 2 5(?: (?:generic|unported))?", "Creative Commons Attribution 2.5 Generic"),
    ("cc-by-3.0", r"creative commons attribution 3(?: 0)?(?: (?:generic|unported))?", "Creative Commons Attribution 3.0 Unported"),
    ("cc-by-4.0", r"creative commons attribution 4(?: 0)?(?: international)?(?: public)?(?: licen[cs]e)?", "Creative Commons Attribution 4.0 International Public License"),
    ("cc-by-sa-1.0", r"creative commons attribution share ?alike 1(?: 0)?(?: generic)?", "Creative Commons Attribution-ShareAlike 1.0 Generic"),
    ("cc-by-sa-2.0", r"creative commons attribution share ?alike 2(?: 0)?(?: generic)?", "Creative Commons Attribution-Share Alike 2.0 Generic"),
    ("cc-by-sa-2.5", r"creative commons attribution share ?alike 2 5(?: generic)?", "Creative Commons Attribution-ShareAlike 2.5"),
    ("cc-by-sa-3.0", r"creative commons attribution share ?alike 3(?: 0)?(?: unported)?", "Creative Commons Attribution-ShareAlike 3.0 Unported"),
    ("cc-by-sa-4.0", r"creative commons attribution share ?alike 4(?: 0)?(?: international)?(?: public)?(?: licen[cs]e)?", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc-by-nc-2.0", r"creative commons attribution non ?commercial 2(?: 0)?(?: generic)?", "Creative Commons Attribution-NonCommercial 2.0 Generic"),
    ("cc-by-nc-3.0", r"creative commons attribution non ?commercial 3(?: 0)?(?: unported)?", "Creative Commons Attribution-NonCommercial 3.0"),
    ("cc-by-nc-4.0", r"creative commons attribution non ?commercial 4(?: 0)?(?: international)?(?: public)?(?: licen[cs]e)?", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nd-3.0", r"creative commons attribution no ?deriv(?:ative)?s? (?:works )?3(?: 0)?(?: unported)?", "Creative Commons Attribution-NoDerivs 3.0"),
    ("cc-by-nd-4.0", r"creative commons attribution no ?deriv(?:ative)?s? (?:works )?4(?: 0)?(?: international)?", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("cc-by-nc-sa-3.0", r"creative commons attribution non ?commercial share ?alike 3(?: 0)?(?: unported)?", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported"),
    ("cc-by-nc-sa-4.0", r"creative commons attribution non ?commercial share ?alike 4(?: 0)?(?: international)?(?: public)?(?: licen[cs]e)?", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("cc-by-nc-nd-3.0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:works )?3(?: 0)?(?: unported)?", "Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported"),
    ("cc-by-nc-nd-4.0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:works )?4(?: 0)?(?: international)?", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
]

#: Names without a version.
NAMES = [
    ("gpl", r"gnu general public license", "the GNU General Public License"),
    ("gpl", r"gnu gpl", "the GNU GPL"),
    ("lgpl", r"gnu (?:lesser|library) general public license", "the GNU Lesser General Public License"),
    ("lgpl", r"gnu lgpl", "the GNU LGPL"),
    ("agpl", r"(?:gnu )?affero general public license", "the Affero General Public License"),
    ("agpl", r"gnu agpl", "the GNU AGPL"),
    ("gfdl", r"gnu free documentation license|gnu fdl|gfdl", "the GNU Free Documentation License"),
    ("gpl-classpath-exception", r"classpath exception", "with the Classpath Exception"),
    ("apache", r"apache (?:software )?license", "the Apache license"),
    ("mit", r"mit licen[cs]e|expat license", "the MIT licence"),
    ("mit", r"(?:licensed|released|distributed|available) under (?:the )?mit", "released under MIT"),
    ("x11", r"x11 license|x consortium license", "X11 License"),
    ("isc", r"isc license", "ISC License"),
    ("bsd", r"bsd(?: style)? licen[cs]e", "a BSD-style license"),
    ("bsd", r"(?:licensed|released|distributed|available) under (?:the )?bsd", "distributed under BSD"),
    ("mpl", r"mozilla public license", "the Mozilla Public License"),
    ("npl", r"netscape public license", "the Netscape Public License"),
    ("epl", r"eclipse public license", "the Eclipse Public License"),
    ("edl", r"eclipse distribution license", "the Eclipse Distribution License"),
    ("cddl", r"common development and distribution license", "the Common Development and Distribution License"),
    ("eupl", r"european union public licen[cs]e", "the European Union Public Licence"),
    ("afl", r"academic free license", "the Academic Free License"),
    ("osl", r"open software license", "the Open Software License"),
    ("artistic", r"(?:perl )?artistic license", "the Perl Artistic License"),
    ("bsl", r"boost software license", "the Boost Software License"),
    ("busl", r"business source license", "a Business Source License"),
    ("ofl", r"(?:sil )?open font license", "the SIL Open Font License"),
    ("ecl", r"educational community license", "the Educational Community License"),
    ("cpl", r"common public license", "the Common Public License"),
    ("cpal", r"common public attribution license", "the Common Public Attribution License"),
    ("ipl", r"ibm public license", "the IBM Public License"),
    ("lppl", r"latex project public license|lppl", "the LaTeX Project Public License"),
    ("odbl", r"open (?:data commons open )?database license|odbl", "the Open Database License"),
    ("odc-by", r"open data commons attribution license|odc by", "the Open Data Commons Attribution License"),
    ("pddl", r"public domain dedication and license|pddl", "the Public Domain Dedication and License"),
    ("qpl", r"q public license", "the Q Public License"),
    ("cecill", r"cecill", "CeCILL"),
    ("zpl", r"zope public license", "the Zope Public License"),
    ("php", r"php license", "the PHP License"),
    ("psf", r"python software foundation license|psf license", "the PSF License"),
    ("apsl", r"apple public source license", "the Apple Public Source License"),
    ("rpl", r"reciprocal public license", "the Reciprocal Public License"),
    ("sspl", r"server side public license|sspl", "the Server Side Public License"),
    ("upl", r"universal permissive license", "the Universal Permissive License"),
    ("mulan-psl", r"mulan permissive software license|mulan psl", "the Mulan Permissive Software License"),
    ("ogl-uk", r"open government licen[cs]e", "the Open Government Licence"),
    ("polyform", r"polyform (?:noncommercial|shield|strict|small business|free trial|internal use) license", "the PolyForm Strict License"),
    ("blueoak", r"blue oak model license", "the Blue Oak Model License"),
    ("openrail", r"open ?rail(?: m)?", "an OpenRAIL-M license"),
    ("bigscience-rail", r"bigscience (?:bloom )?rail(?: license)?", "the BigScience BLOOM RAIL License"),
    ("cdla-permissive", r"(?:community data license agreement|cdla) permissive", "CDLA-Permissive"),
    ("cdla-sharing", r"(?:community data license agreement|cdla) sharing", "CDLA-Sharing"),
    ("zlib", r"zlib(?: libpng)? license", "the zlib/libpng license"),
    ("libpng", r"libpng license|png reference library license", "the PNG Reference Library License"),
    ("unlicense", r"the unlicense|unlicense org", "The Unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", "Do What The Fuck You Want To Public License"),
    ("public-domain", r"(?:dedicated|released|placed) (?:in|in to|into|to) the public domain", "released into the public domain"),
    ("public-domain", r"public domain dedication", "a public domain dedication"),
    ("public-domain", r"this (?:work|file|code|software) is in the public domain", "This file is in the public domain"),
    ("json", r"json license", "The JSON License"),
    ("beerware", r"beer ?ware license", "the Beerware License"),
    ("postgresql", r"postgresql licen[cs]e", "The PostgreSQL Licence"),
    ("ncsa", r"(?:university of illinois )?ncsa open source license", "University of Illinois/NCSA Open Source License"),
    ("ms-pl", r"microsoft public license|ms pl", "Microsoft Public License (Ms-PL)"),
    ("ms-rl", r"microsoft reciprocal license|ms rl", "Microsoft Reciprocal License"),
    ("w3c", r"w3c software (?:notice and )?license|w3c license", "W3C Software Notice and License"),
    ("vim", r"vim license", "the Vim license"),
    ("ruby", r"ruby license|ruby s license", "the Ruby license"),
    ("curl", r"curl license", "the curl license"),
    ("openssl", r"openssl license|ssleay license", "the OpenSSL License"),
    ("unicode", r"unicode license(?: agreement)?", "Unicode License Agreement"),
    ("icu", r"icu license", "the ICU License"),
    ("ftl", r"freetype (?:project )?license", "The FreeType Project LICENSE"),
    ("ijg", r"independent jpeg group license|ijg license", "the Independent JPEG Group License"),
    ("hpnd", r"historical permission notice and disclaimer", "Historical Permission Notice and Disclaimer"),
    ("sleepycat", r"sleepycat license", "the Sleepycat License"),
    ("watcom", r"sybase open watcom public license", "Sybase Open Watcom Public License"),
    ("intel", r"intel open source license", "Intel Open Source License"),
    ("nasa", r"nasa open source agreement", "NASA Open Source Agreement"),
    ("eudatagrid", r"eu datagrid software license", "EU DataGrid Software License"),
    ("nokia", r"nokia open source license", "Nokia Open Source License"),
    ("ricoh", r"ricoh source code public license", "Ricoh Source Code Public License"),
    ("sun-sissl", r"sun industry standards source license", "Sun Industry Standards Source License"),
    ("sun-spl", r"sun public license", "Sun Public License"),
    ("vsl", r"vovida software license", "Vovida Software License"),
    ("xnet", r"x net license", "X.Net License"),
    ("catosl", r"computer associates trusted open source license", "Computer Associates Trusted Open Source License"),
    ("lucent", r"lucent public license", "Lucent Public License"),
    ("frameworx", r"frameworx open license", "Frameworx Open License"),
    ("fair", r"fair license", "the Fair License"),
    ("motosoto", r"motosoto open source license", "Motosoto Open Source License"),
    ("ntp", r"ntp license", "NTP License"),
    ("oclc", r"oclc research public license", "OCLC Research Public License"),
    ("oset", r"oset (?:foundation )?public license", "OSET Public License"),
    ("simpl", r"simple public license", "Simple Public License"),
    ("miros", r"miros licen[cs]e", "MirOS Licence"),
    ("multics", r"multics license", "Multics License"),
    ("naumen", r"naumen public license", "Naumen Public License"),
    ("nethack", r"nethack general public license", "Nethack General Public License"),
    ("tcl", r"tcl tk license|tcl license", "TCL/TK License"),
    ("tmate", r"tmate open source license", "TMate Open Source License"),
    ("entessa", r"entessa public license", "Entessa Public License"),
    ("etalab", r"licence ouverte|open licence etalab|etalab open licen[cs]e", "Licence Ouverte"),
    ("dl-de-by", r"datenlizenz deutschland namensnennung", "Datenlizenz Deutschland Namensnennung 2.0"),
    ("dl-de-zero", r"datenlizenz deutschland zero", "Datenlizenz Deutschland Zero"),
    ("ogl-canada", r"open government licence canada", "Open Government Licence - Canada"),
    ("hippocratic", r"hippocratic license", "the Hippocratic License"),
    ("anti-996", r"anti 996 license", "Anti-996 License"),
    ("cooperative", r"(?:non violent )?cooperative (?:non violent )?software license", "Cooperative Non-Violent Software License"),
    ("parity", r"parity public license", "Parity Public License"),
    ("prosperity", r"prosperity public license", "Prosperity Public License"),
    ("elastic", r"elastic license", "the Elastic License"),
    ("redis-sal", r"redis source available license", "Redis Source Available License"),
    ("timescale", r"timescale license", "Timescale License"),
    ("confluent", r"confluent community license", "Confluent Community License"),
    ("commons-clause", r"commons clause", "Commons Clause"),
    ("source-available", r"source available license", "a source-available license"),
    ("gemma", r"gemma terms of use", "Gemma Terms of Use"),
    ("falcon", r"falcon (?:180b )?tii license", "Falcon TII License"),
    ("deepseek", r"deepseek license(?: agreement)?", "DeepSeek License Agreement"),
    ("qwen", r"(?:tongyi )?qianwen license(?: agreement)?|qwen license(?: agreement)?", "Tongyi Qianwen License Agreement"),
    ("mistral-research", r"mistral (?:ai )?research license", "Mistral AI Research License"),
    ("stability", r"stability ai community license", "Stability AI Community License"),
    ("cc-by", r"cc by", "CC BY"),
    ("cc-by-sa", r"cc by sa", "CC BY-SA"),
    ("cc-by-nc", r"cc by nc", "CC BY-NC"),
    ("cc-by-nd", r"cc by nd", "CC BY-ND"),
    ("cc-by-nc-sa", r"cc by nc sa", "CC BY-NC-SA"),
    ("cc-by-nc-nd", r"cc by nc nd", "CC BY-NC-ND"),
    ("cc-by", r"creative commons attribution", "Creative Commons Attribution"),
    ("cc-by-sa", r"creative commons attribution share ?alike", "Creative Commons Attribution-ShareAlike"),
    ("cc-by-nc", r"creative commons attribution non ?commercial", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?", "Creative Commons Attribution-NoDerivs"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike", "Creative Commons Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "Creative Commons Attribution-NonCommercial-NoDerivs"),
    ("proprietary", r"proprietary license|commercial license", "under a proprietary license"),
    ("proprietary", r"end user licen[cs]e agreement", "End User License Agreement"),
    ("proprietary", r"proprietary and confidential", "Proprietary and confidential"),
]

#: Mentions that say little.
MENTIONS = [
    ("cc", r"creative commons(?: licen[cs]e)?", "a Creative Commons licence"),
    ("all-rights-reserved", r"all rights reserved", "All rights reserved."),
    ("all-rights-reserved", r"alle rechte vorbehalten", "Alle Rechte vorbehalten."),
    ("all-rights-reserved", r"tous droits r[eé]serv[eé]s", "Tous droits réservés."),
    ("all-rights-reserved", r"todos los derechos reservados", "Todos los derechos reservados."),
    ("all-rights-reserved", r"tutti i diritti riservati", "Tutti i diritti riservati."),
    ("all-rights-reserved", r"todos os direitos reservados", "Todos os direitos reservados."),
    ("all-rights-reserved", r"alle rechten voorbehouden", "Alle rechten voorbehouden."),
    ("license-mention", r"licensed under (?:the )?(?:terms of )?(?:the )?(?:\w+ ){1,6}licen[cs]e", "licensed under the terms of the Example Public License"),
    ("license-mention", r"released under (?:the )?(?:terms of )?(?:the )?(?:\w+ ){1,6}licen[cs]e", "released under the Example License"),
    ("license-mention", r"distributed under (?:the )?(?:terms of )?(?:the )?(?:\w+ ){1,6}licen[cs]e", "distributed under the Example Free Licence"),
    ("license-mention", r"published under (?:the )?(?:terms of )?(?:the )?(?:\w+ ){1,6}licen[cs]e", "published under an Example Open License"),
    ("license-mention", r"available under (?:the )?(?:terms of )?(?:the )?(?:\w+ ){1,6}licen[cs]e", "available under the Example Data License"),
    ("license-mention", r"unter der (?:\w+ ){1,5}lizenz", "unter der Beispiel Lizenz"),
    ("license-mention", r"sous (?:la )?licence \w+", "sous la licence Exemple"),
    ("license-mention", r"bajo (?:la )?licencia \w+", "bajo la licencia Ejemplo"),
    ("license-mention", r"see (?:the )?(?:file )?licen[cs]e(?: file)? for (?:more )?(?:details|information)", "See the LICENSE file for details"),
    ("license-mention", r"see copying for (?:more )?(?:details|information)", "See COPYING for details"),
]
