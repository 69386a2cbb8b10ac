"""Digests of whole licences, as ``licenses.canonical_digest`` gives them, by identifier: those too long to be written out.

Fixed values, made of the texts that Debian keeps in /usr/share/common-licenses: each as it is, without what follows its terms, and
with the older postal address. ``licenses.known_licenses`` makes the same of other texts.
"""

DIGESTS = {
    "Apache-2.0": (
        "8bc274b78ed86c607ba1cda8907d306bdcd748d87218adf3dcc786d7f5be76c9",
        "4d6aa515071f3f6f2188c96599b6a575fc0fb402afa0ec1ad84d4f0fabe15cd5",
        "36bf4bc3f65a3a3715a27446fcc6e075c896e3b75cb615136b59a98da8c2d2c8",
    ),
    "Artistic-1.0-Perl": (
        "8b5f84a1f1750e8c739cea292c49e10b88478ded723c19d4739a4d4530984c3b",
    ),
    "CC0-1.0": (
        "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6",
    ),
    "GFDL-1.2": (
        "8b1a4faa5cfb09ff71e6d7c194241622454a6a000ea9167237e0158d7299646c",
    ),
    "GFDL-1.3": (
        "1dbda19c7aa7e1d135ce652fa6c7ee15ce34901ad543ef0e649687611d95fc36",
    ),
    "GPL-1.0": (
        "b3ca47666a022748247f61a82eb3b55168a5552a810eaede7d62b5d8e09953b5",
        "5fb5c5280b754f073c3aaf789cdcd46c162ba39adda60fd9dc57beff4d9998ba",
        "acaf212ad642efc5f2f5206ce1ac68221631ee234b5fafdb1c634ec82425b977",
    ),
    "GPL-2.0": (
        "f68e6284155ba9b10a3f64a480a931bf19b9d68debcba06e584e4ea2f1d05c01",
        "5a00d3722eb9ce3b9260c0b82f76c2f3f2688f4d6763fe0352990dd2a5c66f69",
        "941237c1e331314d43c77c5101f0122c0435407b8fb3a39be1892f578afb6b7c",
        "381186912b58d37d30c33ad9abfa587640a700694fc997aa3383d4dc8cb9451c",
        "ab653165166af3f6b113530caa983a953f10f0ccbebff1a847642f22b00d163b",
        "e878365a1ee1b8bb0fa938b24bb8d82279b411b622f7ee3c1101473408746216",
    ),
    "GPL-3.0": (
        "4fe3e37a4f280e2fa633acd87a7715ab18594b77ae913d8aca6d6aad66538676",
        "4ae9b42ea0d150a0c2e344dd213c7fb19e08671bd1cb7eec75143476df192a14",
        "9d198a9592feec62196b8b8bf79cafc6c94d36348acfb9f6d08a292d04bfff0f",
    ),
    "LGPL-2.0": (
        "c321a341bcb615e6379f46708eda4146999582eb1a37f6d6676a9ec89ee91fad",
        "1e2540e88cb56bb9756b76fd9eca413e2db8621eb06a2e8f978a68e0481b5376",
        "303f01e47e25c79e2f6b8ba49344172a19ecce0d8873a95ddb7064acc425aa37",
        "533d008aa0ffc40cdca43d76ee3ccc6893ec3d40726b670ee32b03b8ac69334f",
        "fe9bbfd7da28f2f0543a409d27ab7a36bd1ee082983be4c9565fc62a08a171a6",
        "7d628df968a462bcdffa90d15512399b65782e8dd93ecfb7478dfd5485b3fafa",
    ),
    "LGPL-2.1": (
        "e48a67e14a89e861adfd7df8813d700993e77be33a1bf93a7e7ae443b19231a3",
        "45136caaa87f790e53f6b4e028e6a30eed5f0ce7526bebf6c573ceb4d00ca4b3",
        "4b6c7487aa6d4349e99fdcc177fa3741d1237ff85e7906b1c8422d26d90b65a5",
        "14724379523c6d55fabaf264af0c64570cde37e9cb0e1b370ef0cedbe3fe3b20",
        "fe59888a93045c045c163da01f1aadb08f23e80479728abb6d3fec2919b49a12",
        "3d3e3a54b9d0e3facc3e45953028d25ea40b2edfa019309b3ba234c25c6cbd78",
    ),
    "LGPL-3.0": (
        "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
    ),
    "MPL-1.1": (
        "2772c161a7ca5eceb4517ee311d5ee8b30c97502771ed5f826ca5e3856ad5c11",
    ),
    "MPL-2.0": (
        "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2",
        "fa31bb5fe4dacb07f1a4ad162be58edb552e9a96a500b68e081943eb2d3cfec5",
    ),
}
