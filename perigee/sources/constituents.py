"""The catalogue of tidal constituents as fixed values, and its dimension tables.

Base constituents have six Doodson multipliers (lunar time, lunar longitude, solar longitude, lunar perigee, negative
node, solar perigee), a phase in cycles, the Rayleigh separation and reference frequency in cycles per hour, and
satellites. Shallow-water constituents are sums of base ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Base constituents.
# index name [Doodson] phase | separation | frequency | (perigee, node, solar perigee; phase; ratio; latitude class) ...
BASE = """
0 Z0 [0,0,0,0,0,0] 0.0 | 0.0 | 0.0 | 
1 SA [0,0,1,0,0,-1] 0.0 | 0.000114085 | 0.0001140741 | 
2 SSA [0,0,2,0,0,0] 0.0 | 0.0002281591 | 0.0002281591 | 
3 MSM [0,1,-2,1,0,0] 0.0 | 0.00020237100000000002 | 0.0013097808 | 
4 MM [0,1,0,-1,0,0] 0.0 | 0.0013097808999999998 | 0.0015121518 | 
5 MSF [0,2,-2,0,0,0] 0.0 | 0.0028219327 | 0.0028219327 | 
6 MF [0,2,0,0,0,0] 0.0 | 0.00022815909999999995 | 0.0030500918 | 
7 ALP1 [1,-4,2,1,0,0] -0.25 | 0.0013097808000000002 | 0.0343965699 | (-1,0,0;0.75;0.036;1) (0,-1,0;0.0;0.1906;0)
8 2Q1 [1,-3,0,2,0,0] -0.25 | 0.0015121519000000014 | 0.0357063507 | (-2,-2,0;0.5;0.0063;0) (-1,-1,0;0.75;0.0241;1) (-1,0,0;0.75;0.0607;1) (0,-2,0;0.5;0.0063;0) (0,-1,0;0.0;0.1885;0)
9 SIG1 [1,-3,2,0,0,0] -0.25 | 0.00020237110000000114 | 0.0359087218 | (-1,0,0;0.75;0.0095;1) (0,-2,0;0.5;0.0061;0) (0,-1,0;0.0;0.1884;0) (2,0,0;0.5;0.0087;0)
10 Q1 [1,-2,0,1,0,0] -0.25 | 0.0015121518 | 0.0372185026 | (-2,-3,0;0.5;0.0007;0) (-2,-2,0;0.5;0.0039;0) (-1,-2,0;0.75;0.001;1) (-1,-1,0;0.75;0.0115;1) (-1,0,0;0.75;0.0292;1) (0,-2,0;0.5;0.0057;0) (-1,0,1;0.0;0.0008;0) (0,-1,0;0.0;0.1884;0) (1,0,0;0.75;0.0018;1) (2,0,0;0.5;0.0028;0)
11 RHO1 [1,-2,2,-1,0,0] -0.25 | 0.0002023709999999998 | 0.0374208736 | (0,-2,0;0.5;0.0058;0) (0,-1,0;0.0;0.1882;0) (1,0,0;0.75;0.0131;1) (2,0,0;0.5;0.0576;0) (2,1,0;0.0;0.0175;0)
12 O1 [1,-1,0,0,0,0] -0.25 | 0.0030500918000000016 | 0.0387306544 | (-1,0,0;0.25;0.0003;1) (0,-2,0;0.5;0.0058;0) (0,-1,0;0.0;0.1885;0) (1,-1,0;0.25;0.0004;1) (1,0,0;0.75;0.0029;1) (1,1,0;0.25;0.0004;1) (2,0,0;0.5;0.0064;0) (2,1,0;0.5;0.001;0)
13 TAU1 [1,-1,2,0,0,0] -0.75 | 0.00022815920000000128 | 0.0389588136 | (-2,0,0;0.0;0.0446;0) (-1,0,0;0.25;0.0426;1) (0,-1,0;0.5;0.0284;0) (0,1,0;0.5;0.217;0) (0,2,0;0.5;0.0142;0)
14 BET1 [1,0,-2,1,0,0] -0.75 | 0.00022815909999999995 | 0.0400404353 | (0,-1,0;0.0;0.2266;0)
15 NO1 [1,0,0,1,0,0] -0.75 | 0.0015121518 | 0.0402685944 | (-2,-2,0;0.5;0.0057;0) (-2,-1,0;0.0;0.0665;0) (-2,0,0;0.0;0.3596;0) (-1,-1,0;0.75;0.0331;1) (-1,0,0;0.25;0.2227;1) (-1,1,0;0.75;0.029;1) (0,-1,0;0.5;0.029;0) (0,1,0;0.0;0.2004;0) (0,2,0;0.5;0.0054;0)
16 CHI1 [1,0,2,-1,0,0] -0.75 | 0.0002023709999999998 | 0.0404709654 | (0,-1,0;0.5;0.0282;0) (0,1,0;0.0;0.2187;0)
17 PI1 [1,1,-3,0,0,1] -0.25 | 0.00011407410000000007 | 0.041438513 | (0,-1,0;0.5;0.0078;0)
18 P1 [1,1,-2,0,0,0] -0.25 | 0.00022815909999999995 | 0.0415525871 | (0,-2,0;0.0;0.0008;0) (0,-1,0;0.5;0.0112;0) (0,0,2;0.5;0.0004;0) (1,0,0;0.75;0.0004;1) (2,0,0;0.5;0.0015;0) (2,1,0;0.5;0.0003;0)
19 S1 [1,1,-1,0,0,1] -0.75 | 0.00011407410000000007 | 0.0416666721 | (0,0,-2;0.0;0.3534;0) (0,1,0;0.5;0.0264;0)
20 K1 [1,1,0,0,0,0] -0.75 | 0.0417807462 | 0.0417807462 | (-2,-1,0;0.0;0.0002;0) (-1,-1,0;0.75;0.0001;1) (-1,0,0;0.25;0.0007;1) (-1,1,0;0.75;0.0001;1) (0,-2,0;0.0;0.0001;0) (0,-1,0;0.5;0.0198;0) (0,1,0;0.0;0.1356;0) (0,2,0;0.5;0.0029;0) (1,0,0;0.25;0.0002;1) (1,1,0;0.25;0.0001;1)
21 PSI1 [1,1,1,0,0,-1] -0.75 | 0.00011407410000000007 | 0.0418948203 | (0,1,0;0.0;0.019;0)
22 PHI1 [1,1,2,0,0,0] -0.75 | 0.00022815909999999995 | 0.0420089053 | (-2,0,0;0.0;0.0344;0) (-2,1,0;0.0;0.0106;0) (0,0,-2;0.0;0.0132;0) (0,1,0;0.5;0.0384;0) (0,2,0;0.5;0.0185;0)
23 THE1 [1,2,-2,1,0,0] -0.75 | 0.0002023710999999942 | 0.043090527 | (-2,-1,0;0.0;0.03;0) (-1,0,0;0.25;0.0141;1) (0,-1,0;0.5;0.0317;0) (0,1,0;0.0;0.1993;0)
24 J1 [1,2,0,-1,0,0] -0.75 | 0.0015121518999999944 | 0.0432928981 | (0,-1,0;0.5;0.0294;0) (0,1,0;0.0;0.198;0) (0,2,0;0.5;0.0047;0) (1,-1,0;0.75;0.0027;1) (1,0,0;0.25;0.0816;1) (1,1,0;0.25;0.0331;1) (1,2,0;0.25;0.0027;1) (2,0,0;0.5;0.0152;0) (2,1,0;0.5;0.0098;0) (2,2,0;0.5;0.0057;0)
27 OO1 [1,3,0,0,0,0] -0.75 | 0.0015379399000000002 | 0.044830838 | (-2,-1,0;0.5;0.0037;0) (-2,0,0;0.0;0.1496;0) (-2,1,0;0.0;0.0296;0) (-1,0,0;0.25;0.024;1) (-1,1,0;0.25;0.0099;1) (0,1,0;0.0;0.6398;0) (0,2,0;0.0;0.1342;0) (0,3,0;0.0;0.0086;0)
28 UPS1 [1,4,0,-1,0,0] -0.75 | 0.0015121518 | 0.0463429898 | (-2,0,0;0.0;0.0611;0) (0,1,0;0.0;0.6399;0) (0,2,0;0.0;0.1318;0) (1,0,0;0.25;0.0289;1) (1,1,0;0.25;0.0257;1)
33 OQ2 [2,-3,0,3,0,0] 0.0 | 0.00020237100000000674 | 0.0759749451 | (-1,0,0;0.25;0.1042;2) (0,-1,0;0.5;0.0386;0)
34 EPS2 [2,-3,2,1,0,0] 0.0 | 0.0013097809000000016 | 0.0761773161 | (-1,-1,0;0.25;0.0075;2) (-1,0,0;0.25;0.0402;2) (0,-1,0;0.5;0.0373;0)
38 2N2 [2,-2,0,2,0,0] 0.0 | 0.00020237099999999286 | 0.077487097 | (-2,-2,0;0.5;0.0061;0) (-1,-1,0;0.25;0.0117;2) (-1,0,0;0.25;0.0678;2) (0,-1,0;0.5;0.0374;0)
39 MU2 [2,-2,2,0,0,0] 0.0 | 0.0013097808000000072 | 0.077689468 | (-1,-1,0;0.25;0.0018;2) (-1,0,0;0.25;0.0104;2) (0,-1,0;0.5;0.0375;0)
41 N2 [2,-1,0,1,0,0] 0.0 | 0.0015121518999999944 | 0.0789992488 | (-2,-2,0;0.5;0.0039;0) (-1,0,1;0.0;0.0008;0) (0,-2,0;0.0;0.0005;0) (0,-1,0;0.5;0.0373;0)
42 NU2 [2,-1,2,-1,0,0] 0.0 | 0.00020237099999999286 | 0.0792016198 | (0,-1,0;0.5;0.0373;0) (1,0,0;0.75;0.0042;2) (2,0,0;0.0;0.0042;0) (2,1,0;0.5;0.0036;0)
45 GAM2 [2,0,-2,2,0,0] -0.5 | 8.829700000000107e-05 | 0.0803090296 | (-2,-2,0;0.0;0.1429;0) (-1,0,0;0.25;0.0293;2) (0,-1,0;0.5;0.033;0)
46 H1 [2,0,-1,0,0,1] -0.5 | 0.00011407410000000007 | 0.0803973266 | (0,-1,0;0.5;0.0224;0) (1,0,-1;0.5;0.0447;0)
47 M2 [2,0,0,0,0,0] 0.0 | 0.0805114007 | 0.0805114007 | (-1,-1,0;0.75;0.0001;2) (-1,0,0;0.75;0.0004;2) (0,-2,0;0.0;0.0005;0) (0,-1,0;0.5;0.0373;0) (1,-1,0;0.25;0.0001;2) (1,0,0;0.75;0.0009;2) (1,1,0;0.75;0.0002;2) (2,0,0;0.0;0.0006;0) (2,1,0;0.0;0.0002;0)
48 H2 [2,0,1,0,0,-1] 0.0 | 0.00011407410000000007 | 0.0806254748 | (0,-1,0;0.5;0.0217;0)
52 LDA2 [2,1,-2,1,0,0] -0.5 | 0.00020237099999999286 | 0.0818211815 | (0,-1,0;0.5;0.0448;0)
53 L2 [2,1,0,-1,0,0] -0.5 | 0.0013097808000000072 | 0.0820235525 | (0,-1,0;0.5;0.0366;0) (2,-1,0;0.0;0.0047;0) (2,0,0;0.5;0.2505;0) (2,1,0;0.5;0.1102;0) (2,2,0;0.5;0.0156;0)
55 T2 [2,2,-3,0,0,1] 0.0 | 0.00011407410000000007 | 0.0832192592 | 
56 S2 [2,2,-2,0,0,0] 0.0 | 0.0028219326000000072 | 0.0833333333 | (0,-1,0;0.0;0.0022;0) (1,0,0;0.75;0.0001;2) (2,0,0;0.0;0.0001;0)
57 R2 [2,2,-1,0,0,-1] -0.5 | 0.00011407410000000007 | 0.0834474074 | (0,0,2;0.5;0.2535;0) (0,1,2;0.0;0.0141;0)
58 K2 [2,2,0,0,0,0] 0.0 | 0.00022815909999999995 | 0.0835614924 | (-1,0,0;0.75;0.0024;2) (-1,1,0;0.75;0.0004;2) (0,-1,0;0.5;0.0128;0) (0,1,0;0.0;0.298;0) (0,2,0;0.0;0.0324;0)
60 ETA2 [2,3,0,-1,0,0] 0.0 | 0.0015121518999999944 | 0.0850736443 | (0,-1,0;0.5;0.0187;0) (0,1,0;0.0;0.4355;0) (0,2,0;0.0;0.0467;0) (1,0,0;0.75;0.0747;2) (1,1,0;0.75;0.0482;2) (1,2,0;0.75;0.0093;2) (2,0,0;0.5;0.0078;0)
68 M3 [3,0,0,0,0,0] -0.5 | 0.0402557003 | 0.120767101 | (0,-1,0;0.5;0.0564;0)
"""

# Shallow-water constituents.
# index name | separation | frequency | coefficient*base ...
SHALLOW = """
25 2PO1 | 0.0 | 0.0443745198 | 2.0*P1 -1.0*O1
26 SO1 | 0.00022815909999999995 | 0.0446026789 | 1.0*S2 -1.0*O1
29 ST36 | 0.0 | 0.0733553835 | 2.0*M2 1.0*N2 -2.0*S2
30 2NS2 | 0.0 | 0.0746651643 | 2.0*N2 -1.0*S2
31 ST37 | 0.0 | 0.0748675353 | 3.0*M2 -2.0*S2
32 ST1 | 0.0 | 0.0748933234 | 2.0*N2 1.0*K2 -2.0*S2
35 ST2 | 0.0 | 0.0764054753 | 1.0*M2 1.0*N2 1.0*K2 -2.0*S2
36 ST3 | 0.0 | 0.0772331498 | 2.0*M2 1.0*S2 -2.0*K2
37 O2 | 0.0 | 0.0774613089 | 2.0*O1
40 SNK2 | 0.0 | 0.0787710897 | 1.0*S2 1.0*N2 -1.0*K2
43 ST4 | 0.0 | 0.079455567 | 2.0*K2 1.0*N2 -2.0*S2
44 OP2 | 0.0 | 0.0802832416 | 1.0*O1 1.0*P1
49 MKS2 | 0.00022815909999999995 | 0.0807395598 | 1.0*M2 1.0*K2 -1.0*S2
50 ST5 | 0.0 | 0.0809677189 | 1.0*M2 2.0*K2 -2.0*S2
51 ST6 | 0.0 | 0.0815930224 | 2.0*S2 1.0*N2 -1.0*M2 -1.0*K2
54 2SK2 | 0.0 | 0.0831051742 | 2.0*S2 -1.0*K2
59 MSN2 | 0.00022815909999999995 | 0.0848454852 | 1.0*M2 1.0*S2 -1.0*N2
61 ST7 | 0.0 | 0.0853018034 | 2.0*K2 1.0*M2 -1.0*S2 -1.0*N2
62 2SM2 | 0.0 | 0.086155266 | 2.0*S2 -1.0*M2
63 ST38 | 0.0 | 0.086357637 | 2.0*M2 1.0*S2 -2.0*N2
64 SKM2 | 0.0 | 0.0863834251 | 1.0*S2 1.0*K2 -1.0*M2
65 2SN2 | 0.0 | 0.0876674179 | 2.0*S2 -1.0*N2
66 NO3 | 0.0 | 0.1177299033 | 1.0*N2 1.0*O1
67 MO3 | 0.0015250459000000077 | 0.1192420551 | 1.0*M2 1.0*O1
69 NK3 | 0.0 | 0.120779995 | 1.0*N2 1.0*K1
70 SO3 | 0.00022815909999999995 | 0.1220639878 | 1.0*S2 1.0*O1
71 MK3 | 0.0015250458999999938 | 0.1222921469 | 1.0*M2 1.0*K1
72 SP3 | 0.0 | 0.1248859204 | 1.0*S2 1.0*P1
73 SK3 | 0.0028219327000000155 | 0.1251140796 | 1.0*S2 1.0*K1
74 ST8 | 0.0 | 0.1566887168 | 2.0*M2 1.0*N2 -1.0*S2
75 N4 | 0.0 | 0.1579984976 | 2.0*N2
76 3MS4 | 0.0 | 0.1582008687 | 3.0*M2 -1.0*S2
77 ST39 | 0.0 | 0.1592824904 | 1.0*M2 1.0*S2 1.0*N2 -1.0*K2
78 MN4 | 0.0015121518 | 0.1595106495 | 1.0*M2 1.0*N2
79 ST9 | 0.0 | 0.1597388086 | 1.0*M2 1.0*N2 1.0*K2 -1.0*S2
80 ST40 | 0.0 | 0.1607946422 | 2.0*M2 1.0*S2 -1.0*K2
81 M4 | 0.04025570029999999 | 0.1610228013 | 2.0*M2
82 ST10 | 0.0 | 0.1612509604 | 2.0*M2 1.0*K2 -1.0*S2
83 SN4 | 0.001309780800000021 | 0.1623325821 | 1.0*S2 1.0*N2
84 KN4 | 0.0 | 0.1625607413 | 1.0*K2 1.0*N2
85 MS4 | 0.0028219327000000016 | 0.163844734 | 1.0*M2 1.0*S2
86 MK4 | 0.00022815910000001383 | 0.1640728931 | 1.0*M2 1.0*K2
87 SL4 | 0.0 | 0.1653568858 | 1.0*S2 1.0*L2
88 S4 | 0.0028219327000000016 | 0.1666666667 | 2.0*S2
89 SK4 | 0.00022815910000001383 | 0.1668948258 | 1.0*S2 1.0*K2
90 MNO5 | 0.0 | 0.1982413039 | 1.0*M2 1.0*N2 1.0*O1
91 2MO5 | 0.0 | 0.1997534558 | 2.0*M2 1.0*O1
92 3MP5 | 0.0 | 0.1999816149 | 3.0*M2 -1.0*P1
93 MNK5 | 0.0 | 0.2012913957 | 1.0*M2 1.0*N2 1.0*K1
94 2MP5 | 0.0 | 0.2025753884 | 2.0*M2 1.0*P1
95 2MK5 | 0.041780746199999996 | 0.2028035475 | 2.0*M2 1.0*K1
96 MSK5 | 0.0 | 0.2056254802 | 1.0*M2 1.0*S2 1.0*K1
97 3KM5 | 0.0 | 0.2058536393 | 1.0*K2 1.0*K1 1.0*M2
98 2SK5 | 0.005643865400000003 | 0.2084474129 | 2.0*S2 1.0*K1
99 ST11 | 0.0 | 0.2372259056 | 3.0*N2 1.0*K2 -1.0*S2
100 2NM6 | 0.0 | 0.2385098983 | 2.0*N2 1.0*M2
101 ST12 | 0.0 | 0.2387380574 | 2.0*N2 1.0*M2 1.0*K2 -1.0*S2
102 2MN6 | 0.0015121519000000083 | 0.2400220501 | 2.0*M2 1.0*N2
103 ST13 | 0.0 | 0.2402502093 | 2.0*M2 1.0*N2 1.0*K2 -1.0*S2
104 ST41 | 0.0 | 0.2413060429 | 3.0*M2 1.0*S2 -1.0*K2
105 M6 | 0.03873065450000002 | 0.241534202 | 3.0*M2
106 MSN6 | 0.0 | 0.2428439828 | 1.0*M2 1.0*S2 1.0*N2
107 MKN6 | 0.0 | 0.2430721419 | 1.0*M2 1.0*K2 1.0*N2
108 ST42 | 0.0 | 0.2441279756 | 2.0*M2 2.0*S2 -1.0*K2
109 2MS6 | 0.0028219327000000016 | 0.2443561347 | 2.0*M2 1.0*S2
110 2MK6 | 0.00022815909999998607 | 0.2445842938 | 2.0*M2 1.0*K2
111 NSK6 | 0.0 | 0.2458940746 | 1.0*N2 1.0*S2 1.0*K2
112 2SM6 | 0.0028219325999999934 | 0.2471780673 | 2.0*S2 1.0*M2
113 MSK6 | 0.00022815910000001383 | 0.2474062264 | 1.0*M2 1.0*S2 1.0*K2
114 S6 | 0.0 | 0.25 | 3.0*S2
115 ST14 | 0.0 | 0.2787527046 | 2.0*M2 1.0*N2 1.0*O1
116 ST15 | 0.0 | 0.2802906445 | 2.0*N2 1.0*M2 1.0*K1
117 M7 | 0.0 | 0.2817899023 | 3.5*M2
118 ST16 | 0.0 | 0.2830867891 | 2.0*M2 1.0*S2 1.0*O1
119 3MK7 | 0.041780746200000024 | 0.2833149482 | 3.0*M2 1.0*K1
120 ST17 | 0.0 | 0.2861368809 | 1.0*M2 1.0*S2 1.0*K2 1.0*O1
121 ST18 | 0.0 | 0.319021299 | 2.0*M2 2.0*N2
122 3MN8 | 0.0 | 0.3205334508 | 3.0*M2 1.0*N2
123 ST19 | 0.0 | 0.3207616099 | 3.0*M2 1.0*N2 1.0*K2 -1.0*S2
124 M8 | 0.03873065449999996 | 0.3220456027 | 4.0*M2
125 ST20 | 0.0 | 0.3233553835 | 2.0*M2 1.0*S2 1.0*N2
126 ST21 | 0.0 | 0.3235835426 | 2.0*M2 1.0*N2 1.0*K2
127 3MS8 | 0.0 | 0.3248675353 | 3.0*M2 1.0*S2
128 3MK8 | 0.0 | 0.3250956944 | 3.0*M2 1.0*K2
129 ST22 | 0.0 | 0.3264054753 | 1.0*M2 1.0*S2 1.0*N2 1.0*K2
130 ST23 | 0.0 | 0.327689468 | 2.0*M2 2.0*S2
131 ST24 | 0.0 | 0.3279176271 | 2.0*M2 1.0*S2 1.0*K2
132 ST25 | 0.0 | 0.3608020452 | 2.0*M2 2.0*N2 1.0*K1
133 ST26 | 0.0 | 0.362314197 | 3.0*M2 1.0*N2 1.0*K1
134 4MK9 | 0.0 | 0.3638263489 | 4.0*M2 1.0*K1
135 ST27 | 0.0 | 0.3666482815 | 3.0*M2 1.0*S2 1.0*K1
136 ST28 | 0.0 | 0.4010448515 | 4.0*M2 1.0*N2
137 M10 | 0.0 | 0.4025570033 | 5.0*M2
138 ST29 | 0.0 | 0.4038667841 | 3.0*M2 1.0*N2 1.0*S2
139 ST30 | 0.0 | 0.405378936 | 4.0*M2 1.0*S2
140 ST31 | 0.0 | 0.4069168759 | 2.0*M2 1.0*N2 1.0*S2 1.0*K2
141 ST32 | 0.0 | 0.4082008687 | 3.0*M2 2.0*S2
142 ST33 | 0.0 | 0.4471596822 | 4.0*M2 1.0*S2 1.0*K1
143 M12 | 0.0 | 0.483068404 | 6.0*M2
144 ST34 | 0.0 | 0.4858903367 | 5.0*M2 1.0*S2
145 ST35 | 0.0 | 0.4874282766 | 3.0*M2 1.0*N2 1.0*K2 1.0*S2
"""


@dataclass(frozen=True)
class Satellite:
    delta: tuple[int, int, int]
    phase: float
    ratio: float
    latitude_class: int


@dataclass(frozen=True)
class Constituent:
    index: int
    name: str
    separation: float
    frequency: float
    doodson: tuple[int, ...] | None = None
    phase: float = 0.0
    satellites: tuple[Satellite, ...] = ()
    terms: tuple[tuple[float, str], ...] = ()


def _base(line: str) -> Constituent:
    head, separation, frequency, rest = (x.strip() for x in line.split("|"))
    index, name, doodson, phase = head.split()
    satellites = []
    for item in rest.split(") ("):
        if item:
            delta, shift, ratio, kind = item.strip("()").split(";")
            satellites.append(Satellite(tuple(map(int, delta.split(","))), float(shift), float(ratio), int(kind)))
    return Constituent(int(index), name, float(separation), float(frequency), tuple(map(int, doodson.strip("[]").split(","))), float(phase), tuple(satellites))


def _shallow(line: str) -> Constituent:
    head, separation, frequency, rest = (x.strip() for x in line.split("|"))
    index, name = head.split()
    terms = tuple((float(c), parent) for c, parent in (x.split("*") for x in rest.split()))
    return Constituent(int(index), name, float(separation), float(frequency), terms=terms)


CATALOG: tuple[Constituent, ...] = tuple(sorted([*map(_base, BASE.strip().splitlines()), *map(_shallow, SHALLOW.strip().splitlines())], key=lambda c: c.index))
BY_NAME = {c.name: c for c in CATALOG}

# Frequency bands of coloured noise, cycles per hour.
BANDS = (
    (0.00010, 0.00417),
    (0.03192, 0.04859),
    (0.07218, 0.08884),
    (0.11243, 0.12910),
    (0.15269, 0.16936),
    (0.19295, 0.20961),
    (0.23320, 0.25100),
    (0.26000, 0.29000),
    (0.30000, 0.50000),
)


def constituent_table(spark: SparkSession) -> DataFrame:
    """constituent_index, name, separation, frequency, phase, doodson (null for shallow-water ones)."""
    rows = [(c.index, c.name, c.separation, c.frequency, c.phase, list(c.doodson) if c.doodson else None) for c in CATALOG]
    return spark.createDataFrame(rows, "constituent_index int, name string, separation double, frequency double, phase double, doodson array<int>")


def satellite_table(spark: SparkSession) -> DataFrame:
    rows = [(c.name, k, *s.delta, s.phase, s.ratio, s.latitude_class) for c in CATALOG for k, s in enumerate(c.satellites)]
    return spark.createDataFrame(rows, "name string, satellite int, d_perigee int, d_node int, d_solar int, phase double, ratio double, latitude_class int")


def term_table(spark: SparkSession) -> DataFrame:
    """name, parent, coefficient of shallow-water constituents."""
    rows = [(c.name, parent, k) for c in CATALOG for k, parent in c.terms]
    return spark.createDataFrame(rows, "name string, parent string, coefficient double")


def band_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(BANDS)], "band int, lower double, upper double")
