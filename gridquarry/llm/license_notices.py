"""Licence notices that the scan looks for, each under the label it stands for."""

from __future__ import annotations

# The wording in which licences ask to be named, and the short
# names of licences. Creative Commons notices follow from the rule below.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU{kind} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"
_WORK = "This work is licensed under the GNU{kind} General Public License, version {version}"
_NOTICES = {
    "afl-3.0": ["Licensed under the Academic Free License version 3.0"],
    "agpl-3.0": [_GNU.format(kind=" Affero", version="3"), _WORK.format(kind=" Affero", version="3"), "AGPL-3.0", "AGPLv3"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "Apache-2.0"],
    "artistic-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0", "Artistic-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-2-clause": ["BSD-2-Clause"],
    "bsd-3-clause": ["BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0", "BSL-1.0"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is licensed under a Creative Commons Zero 1.0 Universal License", "CC0 1.0"],
    "cddl-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "CDDL-1.0"],
    "ecl-2.0": ["Licensed under the Educational Community License, Version 2.0", "ECL-2.0"],
    "epl-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "EPL-1.0"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"],
    "eupl-1.2": ["Licensed under the European Union Public Licence, Version 1.2", "EUPL-1.2"],
    "gfdl-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "GFDL-1.3"],
    "gpl-2.0": [_GNU.format(kind="", version="2"), _WORK.format(kind="", version="2"), "GPL-2.0", "GPLv2"],
    "gpl-3.0": [_GNU.format(kind="", version="3"), _WORK.format(kind="", version="3"), "GPL-3.0", "GPLv3"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISC License"],
    "lgpl-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", _WORK.format(kind=" Lesser", version="2.1"), "LGPL-2.1"],
    "lgpl-3.0": [_GNU.format(kind=" Lesser", version="3"), _WORK.format(kind=" Lesser", version="3"), "LGPL-3.0", "LGPLv3"],
    "mit": ["MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "mpl-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", "MPL-1.1"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "ms-pl": ["Microsoft Public License", "MS-PL"],
    "odbl-1.0": ["Open Database License", "ODbL-1.0"],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "OFL-1.1"],
    "osl-3.0": ["Licensed under the Open Software License version 3.0", "OSL-3.0"],
    "postgresql": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "WTFPL"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "zlib License"],
}
_CC_TERMS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
_CC_KINDS = ["by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa"]
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def notices() -> dict[str, list[str]]:
    """Label: notices of that licence."""
    out = {label: list(texts) for label, texts in _NOTICES.items()}
    for kind in _CC_KINDS:
        for version, suffix in _CC_VERSIONS.items():
            terms = "-".join(_CC_TERMS[part] for part in kind.split("-"))
            out[f"cc-{kind}-{version}"] = [f"This work is licensed under a Creative Commons {terms} {version} {suffix} License", f"CC {kind} {version}"]
    return out
