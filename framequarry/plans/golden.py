"""Known frames: bytes and what they decode to. All are fixed values."""

from __future__ import annotations

#: Name, frame in hex, decoded length (None: malformed, must be refused).
GOLDEN = (
    ("nothing, with checksum", "28b52ffd240001000099e9d851", 0),
    ("one byte, with checksum", "28b52ffd240109000058e51ae36e", 1),
    ("raw block, with checksum", "28b52ffd2419c9000048656c6c6f2c205a7374616e6461726420696e7465726f702120b9d2ea", 25),
    ("one sequence in a block", "28b52ffd6400014d00001041420100fba90e0b3f3fb4f7", 512),
    ("block without bytes", "28b52ffd00001500000000", 0),
    ("literals without sequences", "28b52ffd00008500006848656c6c6f20576f726c64210a8000", 13),
    ("run blocks, with checksum", "28b52ffda4000010000200100002001000020010000200100002001000020010000200100003001000f13e16e1", 1048576),
    ("distance zero", "28b52ffd0000450000080002002f430bae", None),
    ("literals cut off", "28b52ffd000055000072800104207e1f02aa00", None),
    ("bytes after no sequences", "28b52ffd00009500006848656c6c6f20576f726c64210a80000000", None),
    ("one raw block", "28b52ffd200d69000048656c6c6f2c20576f726c6421", 13),
    ("one run block", "28b52ffd204003020041", 64),
)

#: One frame of each historic version, all of the same 239 bytes of text.
LEGACY_FRAMES = {
    1: (
        "fd2fb51e0000b300009d00d81fb00110000000a0ca4ccf43dff9f87b7ffe3fdfdddfc38655633a68704444081f001d00"
        "1d0044218032ad756fb16b3b7a3f77ae8f954a73eccf730c079a9ef05eb4cb940699e63e28f08042a91a2b0edfc90682"
        "b656729849b2beeecd25a1ac860199d428059fc8f91d90306b18089ba0f512c95f4b8037ad145ad2cd9801e877036308"
        "b4a481d8e924b2739f9c0307526a2fc2ce701bffd04e010400540143800700a1283f209c6a30a301c812c00000"
    ),
    2: (
        "22b52ffd0000b160032013001fb00110000000a0ca4ccf43dff9f87b7ffe3fdfdddfc38655633a687044440819001d00"
        "1e00ab658d76e9325a7da319edf694b812ec2ea3b96c35a3554ad4c968563b79db40ea075223995c3eb2b6b36bce9618"
        "2af320000aeded36b5b12e72ba1dcc19ed12519c630ee75ec8b8cdf03984c46e2f27468d900c44218032ad28b34e79ab"
        "798ddbcb8541c1c19a8b35a311e4ab48c0e502ca0c0400540143800700a1283f209c6a30a301c812c00000"
    ),
    3: (
        "23b52ffd0000b15003e012001fb00110000000a0ca4ccf43dff9f87b7ffe3fdfdddfc38655633a687044440819001d00"
        "1d006a59a35dba8c56df6846bb3d25ae04bbcb682e5bcd689512354826a359ede46d03a91f488d6472f9c8daceae395b"
        "62a8cc830028b40f591beb22a7dbc19cd12e11c539e670ee858cdb0c9f4348ecf67262d42844218032ad28b34e79ab79"
        "8ddbcb8541c1c19a8b35a311e4ab48c0e502ca0500540143800700a1283fe0048000a0c18c06204bc00000"
    ),
    4: (
        "24b52ffd000000bbb002c010001eb0010200008000e892341297c8dfe9f3ef53ea1d274f0c44900c8df1b48917001800"
        "18003fe6e2e374d6ecc94ae07171423e644f6a454e78ec49033fc680ab8f755e6f2e3e7ec6dc45696cc5fdc740b8848a"
        "01eba8d14039904c64f8eb53e6180b6712adb899b35a6f8a190301506756f59f358460a06091c90adcababe0e281facf"
        "c6ba010e00540000190000541400242404fe04844e410027e202c4b100d251007958412800e00c0168650004130cda0c"
        "802206c00000"
    ),
    5: (
        "25b52ffd000000ad12b07d1eb0010200008000e892341297c8dfe9f3ef53ea1d274f0c44900c8df1b4890301506756f5"
        "9f358460a06091c90adcababe0e281facfc6baeba8d14039904c64f8eb53e6180b6712adb899b35a6f8af9630cb8fa58"
        "e7f5e6e2e367cc5d94c656dc7f0c844ba8f8632e3e4e67cd9eac041e1727e443f6a456e484c79e340e0000324080a800"
        "014981e03c01291d0087ce807508807224007b5200940020cc0186d200810983c134a08801c00000"
    ),
    6: (
        "26b52ffd42ef0000a612b07d1eb00102000054a0ba248dc425f277fafcfb947ac7c91303112443633c6d220301506756"
        "f59f358460a06091c90adcababe0e281facfc6baeba8d14039904c64f8eb53e6180b6712adb899b35a6f8af9630cb8fa"
        "58e7f5e6e2e367cc5d94c656dc7f0c844ba8f8632e3e4e67cd9eac041e1727e443f6a456e484c79e340e00350b71b5c0"
        "2a5c269422208b4c8d13475867156cf11c4b54109d3150854b540e014b3d01c00000"
    ),
    7: (
        "27b52ffd20ef0000a612e4841fb001100000003559a6e7a1ef7cfcbd3fff9fefeeef61c3aa311d343822220444218032"
        "ad28f3d6280c0a0ed65cac198d205f45022e1750666dac8b9c6e077346bb4414e798c3b917326e337c0e21b1dbcb8951"
        "2334ab9dbc6d20f503a9914c2e1f59dbd935674b0c9579100085a696952edf787b4a5c097697d15c96127535a3554ad4"
        "0b00350b71b5c02a5ce60845f13943f11c4b54109d3150854b540e014b3d01c00000"
    ),
}
