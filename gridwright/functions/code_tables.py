"""Names of GeoKey values: the code tables of the GeoTIFF format that have fewer than 200 entries."""

# Codes of the GeoTIFF format with the names that results show.
CODE_TABLES = {
    "geographic_cs": {
        4201: "GCS_Adindan", 4202: "GCS_AGD66", 4203: "GCS_AGD84", 4204: "GCS_Ain_el_Abd", 4205: "GCS_Afgooye", 4206: "GCS_Agadez", 4207: "GCS_Lisbon", 4208: "GCS_Aratu",
        4209: "GCS_Arc_1950", 4210: "GCS_Arc_1960", 4211: "GCS_Batavia", 4212: "GCS_Barbados", 4213: "GCS_Beduaram", 4214: "GCS_Beijing_1954", 4215: "GCS_Belge_1950",
        4216: "GCS_Bermuda_1957", 4217: "GCS_Bern_1898", 4218: "GCS_Bogota", 4219: "GCS_Bukit_Rimpah", 4220: "GCS_Camacupa", 4221: "GCS_Campo_Inchauspe",
        4222: "GCS_Cape", 4223: "GCS_Carthage", 4224: "GCS_Chua", 4225: "GCS_Corrego_Alegre", 4226: "GCS_Cote_d_Ivoire", 4227: "GCS_Deir_ez_Zor", 4228: "GCS_Douala",
        4229: "GCS_Egypt_1907", 4230: "GCS_ED50", 4231: "GCS_ED87", 4232: "GCS_Fahud", 4233: "GCS_Gandajika_1970", 4234: "GCS_Garoua", 4235: "GCS_Guyane_Francaise",
        4236: "GCS_Hu_Tzu_Shan", 4237: "GCS_HD72", 4238: "GCS_ID74", 4239: "GCS_Indian_1954", 4240: "GCS_Indian_1975", 4241: "GCS_Jamaica_1875", 4242: "GCS_JAD69",
        4243: "GCS_Kalianpur", 4244: "GCS_Kandawala", 4245: "GCS_Kertau", 4246: "GCS_KOC", 4247: "GCS_La_Canoa", 4248: "GCS_PSAD56", 4249: "GCS_Lake", 4250: "GCS_Leigon",
        4251: "GCS_Liberia_1964", 4252: "GCS_Lome", 4253: "GCS_Luzon_1911", 4254: "GCS_Hito_XVIII_1963", 4255: "GCS_Herat_North", 4256: "GCS_Mahe_1971",
        4257: "GCS_Makassar", 4258: "GCS_EUREF89", 4259: "GCS_Malongo_1987", 4260: "GCS_Manoca", 4261: "GCS_Merchich", 4262: "GCS_Massawa", 4263: "GCS_Minna",
        4264: "GCS_Mhast", 4265: "GCS_Monte_Mario", 4266: "GCS_M_poraloko", 4267: "GCS_NAD27", 4268: "GCS_NAD_Michigan", 4269: "GCS_NAD83", 4270: "GCS_Nahrwan_1967",
        4271: "GCS_Naparima_1972", 4272: "GCS_GD49", 4273: "GCS_NGO_1948", 4274: "GCS_Datum_73", 4275: "GCS_NTF", 4276: "GCS_NSWC_9Z_2", 4277: "GCS_OSGB_1936",
        4278: "GCS_OSGB70", 4279: "GCS_OS_SN80", 4280: "GCS_Padang", 4281: "GCS_Palestine_1923", 4282: "GCS_Pointe_Noire", 4283: "GCS_GDA94", 4284: "GCS_Pulkovo_1942",
        4285: "GCS_Qatar", 4286: "GCS_Qatar_1948", 4287: "GCS_Qornoq", 4288: "GCS_Loma_Quintana", 4289: "GCS_Amersfoort", 4290: "GCS_RT38", 4291: "GCS_SAD69",
        4292: "GCS_Sapper_Hill_1943", 4293: "GCS_Schwarzeck", 4294: "GCS_Segora", 4295: "GCS_Serindung", 4296: "GCS_Sudan", 4297: "GCS_Tananarive",
        4298: "GCS_Timbalai_1948", 4299: "GCS_TM65", 4300: "GCS_TM75", 4301: "GCS_Tokyo", 4302: "GCS_Trinidad_1903", 4303: "GCS_TC_1948", 4304: "GCS_Voirol_1875",
        4305: "GCS_Voirol_Unifie", 4306: "GCS_Bern_1938", 4307: "GCS_Nord_Sahara_1959", 4308: "GCS_Stockholm_1938", 4309: "GCS_Yacare", 4310: "GCS_Yoff",
        4311: "GCS_Zanderij", 4312: "GCS_MGI", 4313: "GCS_Belge_1972", 4314: "GCS_DHDN", 4315: "GCS_Conakry_1905", 4322: "GCS_WGS_72", 4324: "GCS_WGS_72BE",
        4326: "GCS_WGS_84", 4801: "GCS_Bern_1898_Bern", 4802: "GCS_Bogota_Bogota", 4803: "GCS_Lisbon_Lisbon", 4804: "GCS_Makassar_Jakarta", 4805: "GCS_MGI_Ferro",
        4806: "GCS_Monte_Mario_Rome", 4807: "GCS_NTF_Paris", 4808: "GCS_Padang_Jakarta", 4809: "GCS_Belge_1950_Brussels", 4810: "GCS_Tananarive_Paris",
        4811: "GCS_Voirol_1875_Paris", 4812: "GCS_Voirol_Unifie_Paris", 4813: "GCS_Batavia_Jakarta", 4901: "GCS_ATF_Paris", 4902: "GCS_NDG_Paris", 4001: "GCSE_Airy1830",
        4002: "GCSE_AiryModified1849", 4003: "GCSE_AustralianNationalSpheroid", 4004: "GCSE_Bessel1841", 4005: "GCSE_BesselModified", 4006: "GCSE_BesselNamibia",
        4007: "GCSE_Clarke1858", 4008: "GCSE_Clarke1866", 4009: "GCSE_Clarke1866Michigan", 4010: "GCSE_Clarke1880_Benoit", 4011: "GCSE_Clarke1880_IGN",
        4012: "GCSE_Clarke1880_RGS", 4013: "GCSE_Clarke1880_Arc", 4014: "GCSE_Clarke1880_SGA1922", 4015: "GCSE_Everest1830_1937Adjustment",
        4016: "GCSE_Everest1830_1967Definition", 4017: "GCSE_Everest1830_1975Definition", 4018: "GCSE_Everest1830Modified", 4019: "GCSE_GRS1980",
        4020: "GCSE_Helmert1906", 4021: "GCSE_IndonesianNationalSpheroid", 4022: "GCSE_International1924", 4023: "GCSE_International1967", 4024: "GCSE_Krassowsky1940",
        4025: "GCSE_NWL9D", 4026: "GCSE_NWL10D", 4027: "GCSE_Plessis1817", 4028: "GCSE_Struve1860", 4029: "GCSE_WarOffice", 4030: "GCSE_WGS84", 4031: "GCSE_GEM10C",
        4032: "GCSE_OSU86F", 4033: "GCSE_OSU91A", 4034: "GCSE_Clarke1880", 4035: "GCSE_Sphere",
    },
    "geodetic_datum": {
        6201: "Datum_Adindan", 6202: "Datum_Australian_Geodetic_Datum_1966", 6203: "Datum_Australian_Geodetic_Datum_1984", 6204: "Datum_Ain_el_Abd_1970",
        6205: "Datum_Afgooye", 6206: "Datum_Agadez", 6207: "Datum_Lisbon", 6208: "Datum_Aratu", 6209: "Datum_Arc_1950", 6210: "Datum_Arc_1960", 6211: "Datum_Batavia",
        6212: "Datum_Barbados", 6213: "Datum_Beduaram", 6214: "Datum_Beijing_1954", 6215: "Datum_Reseau_National_Belge_1950", 6216: "Datum_Bermuda_1957",
        6217: "Datum_Bern_1898", 6218: "Datum_Bogota", 6219: "Datum_Bukit_Rimpah", 6220: "Datum_Camacupa", 6221: "Datum_Campo_Inchauspe", 6222: "Datum_Cape",
        6223: "Datum_Carthage", 6224: "Datum_Chua", 6225: "Datum_Corrego_Alegre", 6226: "Datum_Cote_d_Ivoire", 6227: "Datum_Deir_ez_Zor", 6228: "Datum_Douala",
        6229: "Datum_Egypt_1907", 6230: "Datum_European_Datum_1950", 6231: "Datum_European_Datum_1987", 6232: "Datum_Fahud", 6233: "Datum_Gandajika_1970",
        6234: "Datum_Garoua", 6235: "Datum_Guyane_Francaise", 6236: "Datum_Hu_Tzu_Shan", 6237: "Datum_Hungarian_Datum_1972", 6238: "Datum_Indonesian_Datum_1974",
        6239: "Datum_Indian_1954", 6240: "Datum_Indian_1975", 6241: "Datum_Jamaica_1875", 6242: "Datum_Jamaica_1969", 6243: "Datum_Kalianpur", 6244: "Datum_Kandawala",
        6245: "Datum_Kertau", 6246: "Datum_Kuwait_Oil_Company", 6247: "Datum_La_Canoa", 6248: "Datum_Provisional_S_American_Datum_1956", 6249: "Datum_Lake",
        6250: "Datum_Leigon", 6251: "Datum_Liberia_1964", 6252: "Datum_Lome", 6253: "Datum_Luzon_1911", 6254: "Datum_Hito_XVIII_1963", 6255: "Datum_Herat_North",
        6256: "Datum_Mahe_1971", 6257: "Datum_Makassar", 6258: "Datum_European_Reference_System_1989", 6259: "Datum_Malongo_1987", 6260: "Datum_Manoca",
        6261: "Datum_Merchich", 6262: "Datum_Massawa", 6263: "Datum_Minna", 6264: "Datum_Mhast", 6265: "Datum_Monte_Mario", 6266: "Datum_M_poraloko",
        6267: "Datum_North_American_Datum_1927", 6268: "Datum_NAD_Michigan", 6269: "Datum_North_American_Datum_1983", 6270: "Datum_Nahrwan_1967",
        6271: "Datum_Naparima_1972", 6272: "Datum_New_Zealand_Geodetic_Datum_1949", 6273: "Datum_NGO_1948", 6274: "Datum_Datum_73",
        6275: "Datum_Nouvelle_Triangulation_Francaise", 6276: "Datum_NSWC_9Z_2", 6277: "Datum_OSGB_1936", 6278: "Datum_OSGB_1970_SN", 6279: "Datum_OS_SN_1980",
        6280: "Datum_Padang_1884", 6281: "Datum_Palestine_1923", 6282: "Datum_Pointe_Noire", 6283: "Datum_Geocentric_Datum_of_Australia_1994", 6284: "Datum_Pulkovo_1942",
        6285: "Datum_Qatar", 6286: "Datum_Qatar_1948", 6287: "Datum_Qornoq", 6288: "Datum_Loma_Quintana", 6289: "Datum_Amersfoort", 6290: "Datum_RT38",
        6291: "Datum_South_American_Datum_1969", 6292: "Datum_Sapper_Hill_1943", 6293: "Datum_Schwarzeck", 6294: "Datum_Segora", 6295: "Datum_Serindung",
        6296: "Datum_Sudan", 6297: "Datum_Tananarive_1925", 6298: "Datum_Timbalai_1948", 6299: "Datum_TM65", 6300: "Datum_TM75", 6301: "Datum_Tokyo",
        6302: "Datum_Trinidad_1903", 6303: "Datum_Trucial_Coast_1948", 6304: "Datum_Voirol_1875", 6305: "Datum_Voirol_Unifie_1960", 6306: "Datum_Bern_1938",
        6307: "Datum_Nord_Sahara_1959", 6308: "Datum_Stockholm_1938", 6309: "Datum_Yacare", 6310: "Datum_Yoff", 6311: "Datum_Zanderij",
        6312: "Datum_Militar_Geographische_Institut", 6313: "Datum_Reseau_National_Belge_1972", 6314: "Datum_Deutsche_Hauptdreiecksnetz", 6315: "Datum_Conakry_1905",
        6322: "Datum_WGS72", 6324: "Datum_WGS72_Transit_Broadcast_Ephemeris", 6326: "Datum_WGS84", 6901: "Datum_Ancienne_Triangulation_Francaise",
        6902: "Datum_Nord_de_Guerre", 6001: "DatumE_Airy1830", 6002: "DatumE_AiryModified1849", 6003: "DatumE_AustralianNationalSpheroid", 6004: "DatumE_Bessel1841",
        6005: "DatumE_BesselModified", 6006: "DatumE_BesselNamibia", 6007: "DatumE_Clarke1858", 6008: "DatumE_Clarke1866", 6009: "DatumE_Clarke1866Michigan",
        6010: "DatumE_Clarke1880_Benoit", 6011: "DatumE_Clarke1880_IGN", 6012: "DatumE_Clarke1880_RGS", 6013: "DatumE_Clarke1880_Arc", 6014: "DatumE_Clarke1880_SGA1922",
        6015: "DatumE_Everest1830_1937Adjustment", 6016: "DatumE_Everest1830_1967Definition", 6017: "DatumE_Everest1830_1975Definition",
        6018: "DatumE_Everest1830Modified", 6019: "DatumE_GRS1980", 6020: "DatumE_Helmert1906", 6021: "DatumE_IndonesianNationalSpheroid",
        6022: "DatumE_International1924", 6023: "DatumE_International1967", 6024: "DatumE_Krassowsky1960", 6025: "DatumE_NWL9D", 6026: "DatumE_NWL10D",
        6027: "DatumE_Plessis1817", 6028: "DatumE_Struve1860", 6029: "DatumE_WarOffice", 6030: "DatumE_WGS84", 6031: "DatumE_GEM10C", 6032: "DatumE_OSU86F",
        6033: "DatumE_OSU91A", 6034: "DatumE_Clarke1880", 6035: "DatumE_Sphere",
    },
    "ellipsoid": {
        7001: "Ellipse_Airy_1830", 7002: "Ellipse_Airy_Modified_1849", 7003: "Ellipse_Australian_National_Spheroid", 7004: "Ellipse_Bessel_1841",
        7005: "Ellipse_Bessel_Modified", 7006: "Ellipse_Bessel_Namibia", 7007: "Ellipse_Clarke_1858", 7008: "Ellipse_Clarke_1866", 7009: "Ellipse_Clarke_1866_Michigan",
        7010: "Ellipse_Clarke_1880_Benoit", 7011: "Ellipse_Clarke_1880_IGN", 7012: "Ellipse_Clarke_1880_RGS", 7013: "Ellipse_Clarke_1880_Arc",
        7014: "Ellipse_Clarke_1880_SGA_1922", 7015: "Ellipse_Everest_1830_1937_Adjustment", 7016: "Ellipse_Everest_1830_1967_Definition",
        7017: "Ellipse_Everest_1830_1975_Definition", 7018: "Ellipse_Everest_1830_Modified", 7019: "Ellipse_GRS_1980", 7020: "Ellipse_Helmert_1906",
        7021: "Ellipse_Indonesian_National_Spheroid", 7022: "Ellipse_International_1924", 7023: "Ellipse_International_1967", 7024: "Ellipse_Krassowsky_1940",
        7025: "Ellipse_NWL_9D", 7026: "Ellipse_NWL_10D", 7027: "Ellipse_Plessis_1817", 7028: "Ellipse_Struve_1860", 7029: "Ellipse_War_Office", 7030: "Ellipse_WGS_84",
        7031: "Ellipse_GEM_10C", 7032: "Ellipse_OSU86F", 7033: "Ellipse_OSU91A", 7034: "Ellipse_Clarke_1880", 7035: "Ellipse_Sphere",
    },
    "prime_meridian": {
        8901: "PM_Greenwich", 8902: "PM_Lisbon", 8903: "PM_Paris", 8904: "PM_Bogota", 8905: "PM_Madrid", 8906: "PM_Rome", 8907: "PM_Bern", 8908: "PM_Jakarta",
        8909: "PM_Ferro", 8910: "PM_Brussels", 8911: "PM_Stockholm",
    },
    "coord_transformation": {
        1: "CT_TransverseMercator", 2: "CT_TransvMercator_Modified_Alaska", 3: "CT_ObliqueMercator", 4: "CT_ObliqueMercator_Laborde", 5: "CT_ObliqueMercator_Rosenmund",
        6: "CT_ObliqueMercator_Spherical", 7: "CT_Mercator", 8: "CT_LambertConfConic_2SP", 9: "CT_LambertConfConic_Helmert", 10: "CT_LambertAzimEqualArea",
        11: "CT_AlbersEqualArea", 12: "CT_AzimuthalEquidistant", 13: "CT_EquidistantConic", 14: "CT_Stereographic", 15: "CT_PolarStereographic",
        16: "CT_ObliqueStereographic", 17: "CT_Equirectangular", 18: "CT_CassiniSoldner", 19: "CT_Gnomonic", 20: "CT_MillerCylindrical", 21: "CT_Orthographic",
        22: "CT_Polyconic", 23: "CT_Robinson", 24: "CT_Sinusoidal", 25: "CT_VanDerGrinten", 26: "CT_NewZealandMapGrid", 27: "CT_TransvMercator_SouthOriented",
    },
    "vertical_cs": {
        5001: "VertCS_Airy_1830_ellipsoid", 5002: "VertCS_Airy_Modified_1849_ellipsoid", 5003: "VertCS_ANS_ellipsoid", 5004: "VertCS_Bessel_1841_ellipsoid",
        5005: "VertCS_Bessel_Modified_ellipsoid", 5006: "VertCS_Bessel_Namibia_ellipsoid", 5007: "VertCS_Clarke_1858_ellipsoid", 5008: "VertCS_Clarke_1866_ellipsoid",
        5010: "VertCS_Clarke_1880_Benoit_ellipsoid", 5011: "VertCS_Clarke_1880_IGN_ellipsoid", 5012: "VertCS_Clarke_1880_RGS_ellipsoid",
        5013: "VertCS_Clarke_1880_Arc_ellipsoid", 5014: "VertCS_Clarke_1880_SGA1922_ellipsoid", 5015: "VertCS_Everest1830_1937Adjustment_ellipsoid",
        5016: "VertCS_Everest1830_1967Definition_ellipsoid", 5017: "VertCS_Everest1830_1975Definition_ellipsoid", 5018: "VertCS_Everest1830Modified_ellipsoid",
        5019: "VertCS_GRS1980_ellipsoid", 5020: "VertCS_Helmert1906_ellipsoid", 5021: "VertCS_INS_ellipsoid", 5022: "VertCS_International1924_ellipsoid",
        5023: "VertCS_International1967_ellipsoid", 5024: "VertCS_Krassowsky1940_ellipsoid", 5025: "VertCS_NWL9D_ellipsoid", 5026: "VertCS_NWL10D_ellipsoid",
        5027: "VertCS_Plessis1817_ellipsoid", 5028: "VertCS_Struve1860_ellipsoid", 5029: "VertCS_WarOffice_ellipsoid", 5030: "VertCS_WGS84_ellipsoid",
        5031: "VertCS_GEM10C_ellipsoid", 5032: "VertCS_OSU86F_ellipsoid", 5033: "VertCS_OSU91A_ellipsoid", 5101: "VertCS_Newlyn",
        5102: "VertCS_North_American_Vertical_Datum_1929", 5103: "VertCS_North_American_Vertical_Datum_1988", 5104: "VertCS_Yellow_Sea_1956", 5105: "VertCS_Baltic_Sea",
        5106: "VertCS_Caspian_Sea",
    },
}
