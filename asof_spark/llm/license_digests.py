"""Canonical digests of whole licence texts.

Fixed values: SHA-256 of license_lookup.canonical() of public licence texts as they are distributed with free software
(with their titles or without, and in the spellings in common use). The texts themselves are not needed to look one up. After
a change of canonical() they are to be computed again.
"""

WHOLE_TEXTS = [
    ("Apache-2.0", "0a70aa04e940cff8934f1082f17a3243ee598f6a04fb1f4acc47c3bf779fbb3a"),
    ("Apache-2.0", "8e2427834fb929bc24c7e97ef725006d7a0d43f4c46792d2ce297580877362d7"),
    ("Apache-2.0", "d4122ede206da3b6368dbcda03c61838b4d7a77cd523dd3f62113428b3004890"),
    ("Artistic-1.0", "736961960d51e6e8dd9d54f8bd0c4d50391d354ef3bd0cd932a146eb659cb49f"),
    ("BSD-2-Clause", "0b1aa9d422a528c9e5c759d72d3b4d9285ba612e972920948854e08f5ed5f2ed"),
    ("BSD-2-Clause", "0cdce9cb3bdc735c28190d1a8a7a26cfe603eb2a070b33057bcb92916596d81c"),
    ("BSD-2-Clause", "3b1bf68afac309e9b7fdadf09a9a0f9e05d60abb6e3716fca34de1fef30fbd65"),
    ("BSD-2-Clause", "58c7da1fa6fd472a2f22f6a62c8f55019aa70a5b6507bac96dc9efbe99326619"),
    ("BSD-2-Clause", "63c26c40460617afadabe46e0a59be16d84beab52746e9c4d47664cc077cdb54"),
    ("BSD-2-Clause", "662720481f4c2f58e670ea998d7315172881b64519861bce85a001d03d89082d"),
    ("BSD-2-Clause", "7379b6d9edbd54a9dd2da4ed5206d492a40e6ad779329ce63923f715f00b7ef6"),
    ("BSD-2-Clause", "775102bb86e499f8499335b2860b33fe6d0cdb7db4c041009849f8f757fd0e8d"),
    ("BSD-2-Clause", "8753df7e4c25d449e46fb2e8d8854076d44d8b956b196a7910a215496a7e46b4"),
    ("BSD-2-Clause", "b87686c0e41355fdf4a1b5d26106bf35b572382b5fc9c40d85c08f225df9d21d"),
    ("BSD-2-Clause", "be117d33182e77abb1e6db054ecde1ff7fa17ea879b7f8dfc249dd2168d1d46e"),
    ("BSD-2-Clause", "be43fece2d15c77c72d5639e5ba1b63868531777e8202c5fd5da9283f31194cc"),
    ("BSD-2-Clause", "f6052d86c893bff8f9e6613a1fcbc56415390eb41bc71a5eeded0e09371a0397"),
    ("BSD-3-Clause", "042647a1217a79d5fc2222d3a7f8ac97c64b56024a1ace422beee7079b00a01c"),
    ("BSD-3-Clause", "0abc5ec9696104258d1af17c50f3563096a8ff59c5bb01dbf5cd7a5b76b5f878"),
    ("BSD-3-Clause", "102e4bd4741a06f3ab55dd373747bc78744567370201fcd3056b0e731a1b31a9"),
    ("BSD-3-Clause", "2252ca163caea5d4256e2b7824952580ea85b42b1781fb33c7aa0d85f6fb0ec8"),
    ("BSD-3-Clause", "3f50aac75439dc4d2cfbae39768ae7c9eeedc2f96186b0e9d1f0f2f449f0d6b9"),
    ("BSD-3-Clause", "586ecf83fc448327e46e8519cb03d6788453c93cfdb3868b077008765e773319"),
    ("BSD-3-Clause", "62078e985ce7efb6cdf71e4ff38fbafd3cab3154c116d0ad36f4fdbe55aa0bb7"),
    ("BSD-3-Clause", "6cad9c655871a0800d79c5ec998ee2c2b82089fd8e8dc5ef9d0a74e821d0b9d4"),
    ("BSD-3-Clause", "6f10cefaddf88848e376b3e1374329d753e5422a8c5b19b13c27dff190cabc95"),
    ("BSD-3-Clause", "74837065404c6208add44c96b9a58568876124fc809ce419c3e37d7dbdfce2a7"),
    ("BSD-3-Clause", "81c6bb08cbab3f26108a672edebc3a5422db640be3ea6b97c15940da936fcf07"),
    ("BSD-3-Clause", "84e94a66751a0410692090e97e9a98e49a1bf62d3da147305493936a4de79841"),
    ("BSD-3-Clause", "8b2b9040236ea881e12885e17378177ac46951a62c9c0ccfadb136b99a801682"),
    ("BSD-3-Clause", "8ccad002eff6bf874ebce9bf78e984e7b0a5331a37914a28c0661b4fe79beada"),
    ("BSD-3-Clause", "946f29cbd167b9c5b0299b988dfc0072d7097a0ffc44953f46de0153161acf80"),
    ("BSD-3-Clause", "9a976df3b7219a994d1b8a9b4a043aa0b286693888a8643a561785823cc469e3"),
    ("BSD-3-Clause", "9ce288e9f3cd0b7a2c629247e39686204dab6d642b34b65b48a2877fbd24e796"),
    ("BSD-3-Clause", "a177162f532b5a6b57e224191fa7ea03b75e85c84e528caa2c18c5c64a2b7446"),
    ("BSD-3-Clause", "a2ded6568931f3a404efa25aebcdd6ad1c11a523d9a9726e36ea47a55e0e00bf"),
    ("BSD-3-Clause", "a64b3c171ddb7336ac55a12a23766723ce335a58dd86d33848a85e8da569759e"),
    ("BSD-3-Clause", "b348f0a5ca1527506b1d3d2a6e2d72e30c57b969107e38d7715fe92d9d646a07"),
    ("BSD-3-Clause", "b8ba6e18423078d41f918edf22447641c2e54d3ab3eb66c16907febc39dac301"),
    ("BSD-3-Clause", "d39ad7af67d6c3c533bab67ba66d42e0368c914b1bf1d2af9485d97d84a94a45"),
    ("BSD-3-Clause", "d4100e4c7afebeebc7cc839cd2df6b1435681f34282627c5f0c05b16a90a8c12"),
    ("BSD-3-Clause", "ea634a75ac0e0af151da52086a83e458ef322f46649e3b95addcbd4b4d54d6d2"),
    ("BSD-3-Clause", "eb2ba1602ff1c0be63ac99c3c2ecc21f250ce84951020ce63218e6ff48726636"),
    ("BSD-3-Clause", "ebe0352fd9697fcf6676687b6bf5cbfd8533be0310e85fa37494be039f1e5d29"),
    ("BSL-1.0", "fc45de29ef4aaaef03f095fc03d39450a2438c16111771b15530a07d38c5aa71"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.3", "4a1efdfb55a8e519a7e927e9589ebbd002a8d6d20b5d6622a6d53290e045edf9"),
    ("GPL-1.0", "2719bd2781283b498433813ae2c1146a9ad8cd7cb6521ec219bb444e6c734d29"),
    ("GPL-2.0", "56fee2b78dd111a363125d63e469c88e7f708e96011c9285dd3e9d8197dc19bf"),
    ("GPL-2.0", "e95c79f738afaabb94ef2b2f1dccfe7a99aa36417f83957006e7a94e2efd3e93"),
    ("GPL-3.0", "0616e1cb8ad59cf1a2431157b42070a63daab953be8953e03d6d80ce2b06c7a5"),
    ("GPL-3.0", "97126806f34c2065fab1d94d05ef5d33e5411ba6b10b34b4a24a8c88989878ca"),
    ("GPL-3.0", "b764761722a41a9f205d7f5e3f5e5c805f5c0d0dba77c7d0402b1fdc697cbdc5"),
    ("ISC", "19fa00054f6206843d4927034773363a50fa6329f9caf1574ddf32c791d90618"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1"),
    ("ISC", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("ISC", "42946511a83e28f311705b31247163141fd1157d2c9b9923c5292ca9d1299c63"),
    ("ISC", "5fb628af212d6618ceee2210c60a5dee79b64f7c54d6cb2c7b40f19369024708"),
    ("ISC", "67089e452ac55861253143b499d8fd7c5bab6c47c897ed2e0e99f1ee13cacf99"),
    ("ISC", "6e9dc1cd727a12354f4cef293d9d285ed81ed312d597842774d1120ac62a6dc6"),
    ("ISC", "900cc52c54f57ff822ce03c88db679f0635b14f6b8de4bdd6d9466675430b5b5"),
    ("ISC", "94b4e9f723d13830ec6a47b422738caee264943af1673fa32782cefd730ffc82"),
    ("ISC", "badb3e2e8e65a9cbedbab2a9ce9da2aca8aa8188a5725c43da81abd61b34985c"),
    ("ISC", "c5e3a360a272f9fb60a04a13cfb0142ba1668661bcc5ee8123ce10c6e9c622ad"),
    ("ISC", "dcec6d2fdf7cfb76315416b661ea23a66e68248a5f6ef023a5d2199c4671748c"),
    ("ISC", "e00f31f158e77a60e7375307e014eeb17754967f6d6757d019567221315db4e1"),
    ("ISC", "e1ccfd811b62e1f17a53d7a6dc8dfee27c6bb56546a2053bb27424138152c21a"),
    ("LGPL-2.0", "b74f2cec316aa7e4d6647a143de17cee9b4e6ba7e9eae60efcbdc4a4e63c7a4d"),
    ("LGPL-2.1", "82e33cdcaaf59e385837572438c182da399fd4ce919bce81f0423da0a1bb8f4c"),
    ("LGPL-2.1", "c6f4c9941ea71155b0552a3eb882eda4fb4978048a1818a01eea11f85721f4e5"),
    ("LGPL-3.0", "56482b1c7f665d4c7f789e4101b8a8be875572d70c56d6483f0dd69f153190d6"),
    ("MIT", "00a5c934b705d69594539c6a37a1105192217249a30fe111a375560a492639c9"),
    ("MIT", "0448408b209629d6594f847f0a87c88a2514d138675418d8a5f48e5eadd2b0c9"),
    ("MIT", "088820cdfa4ac7a222b290bd34f8f64641a3840eb81601ace493277cac997f00"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "14e109e165ae066a421632a20c5ca0d833dc9ff4e8905fa49aa118bda59329dd"),
    ("MIT", "2bb227177693292f3ceff75743a7f3bcb0ad150378a0a91eedeb1e8c7a5a4097"),
    ("MIT", "359bc03eebe6a2473188facdfdfe38db69ceffdfd3953d8b84141ad64d2544f8"),
    ("MIT", "3644bd78b316a4c03a368c30f54a935226acd63f7f599c48207cc6968ea8ce44"),
    ("MIT", "3775adb5755a427958b31fee52e469536e1b95aa0a259a3cdcbb5f7da0150737"),
    ("MIT", "44295ce3f73e95d9265fd78dccb7ef474028956424531092f12c46ea7bbd4e16"),
    ("MIT", "56a72321165a0b255cb075f898b68ba6df4399569d4425d8957d4c65f9619961"),
    ("MIT", "5d01a1651a4c284dfbbf1500c7a5c7abb115387c003fbedd1e4624fe9b90b141"),
    ("MIT", "5ed8a45d24d1e5d0a2dd7e39b054c6ff106bbeb26a8cf89ba922edbdc10441e5"),
    ("MIT", "6322cfa2f28849930d0ef51c1efc8e48782b3fd1cd03d177a9b8adfe897ed7d0"),
    ("MIT", "64419029c3359dd14b57c1173479e700a39608ab0056f0ae9b6551273fda7b80"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c7313f19979715eb65684704e87d56e8bdab276d554d7b280457f1754bd0b93"),
    ("MIT", "6d48bf7e2f8b0ea5970854ec5175b9dd123de13bb22ef0cd9ed4a83f99d5c188"),
    ("MIT", "730c572e0dbb5146390435c0348e39cbbcf7c54be59e4057c95ca4f3a984f85f"),
    ("MIT", "7419ba21733d75e748e98136720795f999057e4cb070709ba6f0b7dcd64cef77"),
    ("MIT", "7518c5aa519e97b1f392a8c0652386c979ef2abba4d0e3f41ea2c54365fb610b"),
    ("MIT", "788eaecd714733a2f5146cc43de574732fd7fe758b22dbab8ae18feb1351392b"),
    ("MIT", "86c1efed6e37ebed94cce0e5e31c61d95ee024bea5db8d40da3c880764bb1457"),
    ("MIT", "8a1d298ea12b863dc3c05c5ae301f78075c4aa9e99f0422505f6286a8e6b459c"),
    ("MIT", "94dc2756aa068347d32bc82ecd9f7f309e2a0b433f62b5d2ea960fa9d4ded8fb"),
    ("MIT", "98e395db7c05ad9bd1209b086e069ba3632a828f483268fddfd1a676c2fc5cf0"),
    ("MIT", "9b39733c3da9abe80b24d4911ac297e50dc9b36ff806e7479d8705dea5a90854"),
    ("MIT", "9d4ed8e920acd14eb4639a2f3886503942bcaa1fbe45059a769ad51bf564bf8a"),
    ("MIT", "a157e8112f953e6d8dab7a2a247234879969b800fbf7f9791f78194cfab5b3a2"),
    ("MIT", "ab4a32d9a7e13b91cb335ed4bb44f29417775bbcb60d1d9382c2b37066dd3b4b"),
    ("MIT", "ac43a6892fe6081daba3454f52b1bf7a0862bee8cab05c43cb51aef2dcaf7149"),
    ("MIT", "ad715b099a0365dad3915cd467d26da81b04990080944e75e25bf1ce20b1d62d"),
    ("MIT", "ad91da9f98d9c07b68650da292d4270141d3be3ab944d463103d1a347f43f66c"),
    ("MIT", "b9f0e99bed2386138acd4f25a2947b7fdf1e53758034e5c5205c3d7205fc8073"),
    ("MIT", "ba57d3af5e2715d52f963fa747bec35204897610b22f12b41c780332971e2e97"),
    ("MIT", "c6ad8e2d3c4b04b0c8e25afb5297d47ee7aa24eb5b7464ad26423d0d8f9a96cc"),
    ("MIT", "cb926d1e612a5521583dae2b049deb599639834983be3e5d076aee3c4483aa38"),
    ("MIT", "d1aa868b2e4489662816dbfeef5fa64520d74bd29de87cdedc59e18da5206b54"),
    ("MIT", "d45ce39c4f678f0d4e142759c1438e6ad2a849e42f4e8848cbb80eb4702fc0ce"),
    ("MIT", "db0b7e132319fe0d3fb9e9d8ec1fea3a101040a2a5f9b88c26b7587fd5632d03"),
    ("MIT", "e39b4dc67fd149ecaf94afedfdaba96df9f06f7cddd4dd03d64d2da254504387"),
    ("MIT", "e825b0f584592df6ddf760447f2eebc6a2ebd94dbe275f213783f30b2396ac1f"),
    ("MIT", "ef26e50407fd34db29d0a251333be3756517973665ae2a0900b9a6c991b080b2"),
    ("MIT", "f315ae73badba285cc787076df992244fec9fc0f2ff2cbb5b806a946107be70d"),
    ("MPL-1.1", "271b19dc2af084083bbcb12ee46795c55a805886ef51fc095e69765554980c14"),
    ("MPL-2.0", "5b1cbceba7dc8b9ef86de1556f754bb4cdc83b4c1d0b27eae436bdcfb347d3d6"),
    ("MPL-2.0", "b044390ccd6522cb56cae4a6fd841499ef5fcbb51f51330cd98d7d02a55251f8"),
    ("MPL-2.0", "bba681e83fe4d8a8f53d4872cd7677232ae65eac918f8bcf7d013d2ade6f1f04"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
    ("Zlib", "b6548c47b5f6dcd55fa885fc443a69dc70c26d8370133a18f9f93d38f885c17a"),
]
