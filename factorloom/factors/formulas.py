"""Formulas of the two classic families.

Fixed values: the definitions that give the 191 and 101 columns, one a line, number = formula.
``rank`` and ``scale`` work across a date, all else along a ticker (see ``expressions``).
"""

# fmt: off
ALPHA191 = """
1 = -corr(rank(delta(log(volume), 1)), rank((close - open) / open), 6)
2 = -delta((close - low - (high - close)) / where((high - low).same(0), 0.0001, high - low), 1)
3 = ts_sum(where(close.same(delay(close, 1)), 0, where(close > delay(close, 1), close - least(low, delay(close, 1)), close - greatest(high, delay(close, 1)))), 6)
4 = -corr(ts_rank(close, 10), ts_rank(volume / (mean(volume, 60) + 1), 4), 7)
5 = -ts_max(corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)
6 = -rank(sign(delta(open * 0.85 + high * 0.15, 4)))
7 = rank(ts_max(vwap - close, 15)) * rank(ts_min(vwap - close, 15)) * rank(delta(volume, 3))
8 = -rank(delta((high + low) / 2 * 0.2 + vwap * 0.8, 4))
9 = mean(high - low, 10) / mean(close, 10)
10 = rank(ts_max(std(returns, 5), 5))
11 = ts_sum((close - low - (high - close)) / (high - low + 0.001) * volume, 6)
12 = rank(ts_min(delta(vwap, 1), 5)) * ts_rank(ts_max(std(returns, 10), 10), 5)
13 = (high * low) ** 0.5 - vwap
14 = close - delay(close, 5)
15 = open / delay(close, 1) - 1
16 = -ts_max(rank(corr(rank(volume), rank(vwap), 5)), 5)
17 = -rank(ts_min(delta(close, 10), 10))
18 = std(abs(close - open), 5) + (close - open) + corr(close, open, 10)
19 = -sign(close - delay(close, 7)) * (1 + rank(1 + ts_sum(returns, 250)))
20 = (open - delay(high, 1)) * (open - delay(close, 1)) * (open - delay(low, 1))
21 = mean(close, 6) / close - 1
22 = mean(close - mean(close, 60), 20)
23 = mean(close, 20)
24 = close - delay(close, 6)
25 = -rank(delta(close, 7) * (1 - rank(decay(volume / mean(volume, 20), 9))))
26 = ts_max(close, 50) / close
27 = rank(corr(ts_rank(volume, 10), ts_rank(vwap, 10), 6))
28 = std(close, 5)
29 = ts_min(delta(close, 9), 9)
30 = close - delay(close, 20)
31 = (close - mean(close, 10)) / mean(close, 10)
32 = -ts_sum(rank(corr(high, volume, 5)), 5)
33 = rank(-ts_min(low, 5)) + ts_rank(delay(vwap, 5), 5)
34 = mean(close, 12) / close
35 = ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))
36 = 2.21 * rank(corr(close, open, 5)) + 0.7 * rank(open - close) + 0.73 * rank(ts_rank(delay(-returns, 6), 5)) + rank(abs(corr(vwap, returns, 6))) + 0.6 * rank((mean(close, 200) - close) / close)
37 = rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)
38 = -rank(ts_rank(close, 10)) * rank(close / open)
39 = -rank(delta(close, 7) * (1 - rank(decay(volume / mean(volume, 20), 9))))
40 = rank(volume) * ts_rank(close, 5)
41 = -rank(ts_max(delta(vwap, 3), 5))
42 = rank(std(high, 10)) * corr(high, volume, 10)
43 = ts_sum(close > delay(close, 1), 6) / 6
44 = -corr(high, rank(volume), 5)
45 = -rank(ts_sum(delay(close, 5), 20) / 20) * corr(close, volume, 2) * rank(corr(ts_sum(close, 5), ts_sum(close, 20), 2))
46 = (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10
47 = mean(close, 60) - close
48 = -rank(sign(close - delay(close, 1)) + sign(delay(close, 1) - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3))) * ts_sum(volume, 5) / ts_sum(volume, 20)
49 = ts_sum(high + low >= delay(high, 1) + delay(low, 1), 20) / 20
50 = ts_sum(high + low <= delay(high, 1) + delay(low, 1), 20) / 20
51 = ts_sum(high + low > delay(high, 1) + delay(low, 1), 20) / 20
52 = ts_sum(ts_max(high, 4), 12) / ts_sum(ts_min(low, 4), 12)
53 = ts_sum(close > delay(close, 1), 12) / 12
54 = -rank(std(returns, 10))
55 = corr(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12) + 0.001)), rank(volume), 6)
56 = rank(ts_max(returns, 10))
57 = mean(close - ts_min(low, 9), 9)
58 = ts_sum(close > delay(close, 1), 20) / 20
59 = ts_sum(close - delay(close, 1) < 0, 20) / 20
60 = ts_sum((close - low - (high - close)) / (high - low + 0.001) * volume, 20)
61 = rank(decay(delta(vwap, 1), 10))
62 = -corr(high, volume, 10)
63 = mean(close, 20)
64 = mean(corr(ts_rank(volume, 10), ts_rank(vwap, 10), 4), 10)
65 = mean(close, 6) / close
66 = close / ts_max(close, 240)
67 = mean(returns, 5)
68 = ts_min(close, 240) / close
69 = rank(ts_max(delta(vwap, 3), 5))
70 = std(turnover_rate, 10)
71 = corr(ts_rank(close, 10), ts_rank(delta(close, 3), 10), 3)
72 = mean(ts_max(high, 6) - close, 20) / mean(ts_min(low, 6) - close, 20)
73 = ts_rank(decay(decay(delta(close, 1), 10), 10), 5) - rank(decay(corr(vwap, mean(volume, 30), 4), 10))
74 = rank(corr(close, ts_sum(mean(volume, 30), 37), 15)) < rank(corr(rank(vwap), rank(volume), 18))
75 = rank(corr(vwap, volume, 4))
76 = rank(delta(close, 20))
77 = rank(decay(delta(close, 3) / delay(close, 3), 20))
78 = rank(corr(ts_sum(low, 5), ts_sum(mean(volume, 60), 20), 7))
79 = rank(delta(close, 7))
80 = rank(sign(delta(high, 1)))
81 = rank(log(vwap / close))
82 = rank(delta(open, 1))
83 = rank(high * low / close ** 2)
84 = ts_sum(close / delay(close, 5), 30)
85 = rank(corr(close, volume, 10))
86 = -rank(close / delay(close, 1) - 1)
87 = rank(corr(vwap, delta(vwap, 2), 6))
88 = rank(decay(rank(close), 10))
89 = ts_rank(decay(corr(low, volume, 10), 7), 6)
90 = rank(corr(rank(vwap), rank(volume), 7))
91 = rank(close * volume)
92 = rank(decay(corr(rank(vwap), rank(volume), 4), 10))
93 = ts_rank(decay(corr(vwap, volume, 3), 5), 3)
94 = -rank(vwap - ts_min(vwap, 11))
95 = rank(open - mean(volume, 10))
96 = rank(decay(corr(vwap, returns, 4), 7))
97 = rank(std(close, 10))
98 = rank(delta(ts_sum(close, 100) / 100, 100) / delay(close, 100))
99 = -rank(corr(high, volume, 5))
100 = std(volume, 20)
101 = (close - open) / (high - low + 0.001)
102 = mean(volume, 10)
103 = (ts_min(low, 20) - low) / (ts_max(high, 20) - ts_min(low, 20) + 0.001)
104 = -delta(corr(high, volume, 5), 5)
105 = -corr(rank(open), rank(volume), 10)
106 = close - delay(close, 20)
107 = -rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1))
108 = rank(corr(rank(high), rank(volume), 3))
109 = mean(high, 10) / high
110 = ts_sum(ts_max(high, 10), 10) / ts_sum(ts_min(low, 10), 10)
111 = mean(volume * (close - low - (high - close)) / (high - low + 0.001), 11)
112 = ts_sum(close - delay(close, 1) > 0, 12) / 12
113 = -rank(decay(delta(close, 7), 8))
114 = rank(ts_rank(delay((high - low) / close, 2), 20)) * rank(ts_rank(corr(close, volume, 6), 2))
115 = rank(corr(high ** 2, volume, 5))
116 = close / delay(close, 10) - 1
117 = ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))
118 = ts_sum(high, 20) / 20
119 = rank(decay(corr(vwap, volume, 4), 7))
120 = rank(vwap - close) / rank(vwap + close)
121 = rank(ts_max(delta(vwap, 1), 5))
122 = mean(mean(mean(log(close), 13), 13), 13)
123 = rank(corr(ts_sum(high, 5), ts_sum(mean(volume, 40), 5), 10))
124 = close - vwap
125 = rank(decay(corr(vwap, returns, 4), 7))
126 = close / delay(close, 20)
127 = rank(mean(volume, 10))
128 = 100 - ts_rank(ts_sum(close, 10), 10)
129 = ts_sum(close - delay(close, 1) < 0, 12) / 12
130 = rank(decay(corr(vwap, volume, 10), 10))
131 = rank(delta(vwap, 1))
132 = mean(turnover, 20)
133 = ts_rank(close, 10)
134 = close / delay(close, 12) - 1
135 = mean(delta(close, 3), 20)
136 = -rank(delta(returns, 3)) * corr(open, volume, 10)
137 = -rank(open - delay(open, 1))
138 = ts_rank(delay(close / high, 2), 5)
139 = -corr(open, volume, 10)
140 = ts_min(rank(rank(log(volume))), 5)
141 = rank(corr(rank(high), rank(volume), 3))
142 = -rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / mean(volume, 20), 5))
143 = close > delay(close, 1)
144 = ts_sum(close / delay(close, 1) - 1 - mean(close / delay(close, 1) - 1, 61), 20)
145 = mean(volume, 9) - mean(volume, 26)
146 = mean(close / delay(close, 1) - 1, 61)
147 = ts_rank(corr(rank(close), rank(volume), 4), 4)
148 = rank(corr(delay(open, 1), volume, 10))
149 = rank(corr(open, volume, 10))
150 = (open + high + low + close) / 4
151 = mean(close - delay(close, 1), 20)
152 = mean(mean(close / delay(close, 20) - 1, 20), 20)
153 = close / delay(close, 3) - 1
154 = (vwap - ts_min(vwap, 15)) * rank(corr(vwap, mean(volume, 40), 17))
155 = mean(volume, 13) - mean(volume, 27)
156 = ts_rank(decay(rank(open) + rank(low) - rank(high) - rank(close), 8), 7)
157 = ts_min(close, 20)
158 = (high - low) / close
159 = (close - ts_sum(close, 6)) / 6 + (close - ts_sum(close, 24)) / 24
160 = mean(close <= delay(close, 1), 20)
161 = ts_max(close, 10)
162 = mean(ts_max(close, 12) - ts_min(close, 12), 12)
163 = rank(decay(delta(close, 5), 3))
164 = mean(close > delay(close, 1), 10)
165 = ts_max(close, 240) - ts_min(close, 240)
166 = -20 * mean(close / delay(close, 20) - 1, 20)
167 = ts_sum(close - delay(close, 1) > 0, 20)
168 = -1 * volume / mean(volume, 20)
169 = mean(close, 20)
170 = rank(1 / close) * volume / mean(volume, 20) * (high * rank(high - close)) / ts_sum(high, 5)
171 = -1 * (low - close) * open ** 5 / (close - open) ** 2
172 = mean(corr(high, low, 4), 10)
173 = 3 * mean(close, 13) - 2 * mean(mean(close, 13), 13) - mean(mean(mean(close, 13), 13), 13)
174 = mean(close, 39)
175 = mean(close, 13)
176 = corr(rank(close), rank(volume), 5)
177 = ts_min(low, 30)
178 = close / delay(close, 5)
179 = rank(corr(vwap, open, 18))
180 = rank(volume)
181 = rank(corr(low, open, 10))
182 = ts_sum(open > delay(open, 1), 20)
183 = rank(corr(close, open, 10))
184 = rank(corr(low, volume, 6))
185 = rank(-(close - delay(close, 7)))
186 = ts_sum(open, 21) / 21 - ts_sum(open, 63) / 63
187 = ts_sum(open <= delay(open, 1), 20)
188 = (high - low) / mean(close, 50)
189 = mean(close, 26) - mean(close, 12)
190 = log(ts_sum(volume, 20))
191 = corr(mean(vwap, 20), mean(volume, 20), 18)
"""

ALPHA101 = """
1 = rank(argmax(where(returns < 0, std(returns, 20), close) ** 2, 5))
2 = -corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6)
3 = -corr(rank(open), rank(volume), 10)
4 = -ts_rank(rank(low), 9)
5 = rank(open - ts_min(open, 10)) - rank(rank(close) - ts_min(close, 10))
6 = -corr(open, volume, 10)
7 = where(mean(volume, 20) >= volume, -1, -ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7)))
8 = -rank(ts_sum(open, 5) * ts_sum(returns, 5) - delay(ts_sum(open, 5) * ts_sum(returns, 5), 10))
9 = where((ts_min(delta(close, 1), 5) > 0) | (ts_max(delta(close, 1), 5) < 0), delta(close, 1), -delta(close, 1))
10 = where((ts_min(delta(close, 1), 4) > 0) | (ts_max(delta(close, 1), 4) < 0), delta(close, 1), -delta(close, 1))
11 = (rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))
12 = sign(delta(volume, 1)) * -delta(close, 1)
13 = -rank(cov(rank(close), rank(volume), 5))
14 = -rank(delta(returns, 3)) * corr(open, volume, 10)
15 = -ts_sum(rank(corr(rank(high), rank(volume), 3)), 3)
16 = -rank(cov(rank(high), rank(volume), 5))
17 = -rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / mean(volume, 20), 5))
18 = -rank(std(abs(close - open), 5) + (close - open) + corr(close, open, 10))
19 = -sign(close - delay(close, 7)) + rank(growth(returns))
20 = -rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1))
21 = where((mean(close, 8) + std(close, 8) < mean(close, 2)) | (mean(volume, 20) / volume < 1), -1, 1 + 0 * (close.same(close)))
22 = -delta(corr(high, volume, 5), 5) * rank(std(close, 20))
23 = where(mean(high, 20) < high, -delta(high, 2), 0 * (close.same(close)))
24 = where(delta(mean(close, 100), 100) / delay(close, 100) <= 0.05, -(close - ts_min(close, 100)), -delta(close, 3))
25 = -rank(-returns * mean(volume, 20) * vwap * (high - close))
26 = -ts_max(corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)
27 = -rank((mean(volume, 10) - mean(volume, 20)) / mean(volume, 60))
28 = scale(corr(mean(volume, 20), low, 5) + (high + low) / 2 - close)
29 = ts_min(rank(rank(scale(log(ts_sum(rank(rank(-rank(delta(close - 1, 5)))), 2))))), 5) + ts_rank(delay(-returns, 6), 5)
30 = (1 - rank(sign(delta(close, 1)) + sign(delay(delta(close, 1), 1)) + sign(delay(delta(close, 1), 2)))) * ts_sum(volume, 5) / ts_sum(volume, 20)
31 = rank(rank(rank(decay(-rank(rank(delta(close, 10))), 10)))) + rank(-delta(close, 3)) + sign(scale(corr(mean(volume, 20), low, 12)))
32 = scale(mean(close, 7) - close + (ts_min(close, 180) - close))
33 = rank(-(1 - open / close))
34 = rank(1 - rank(std(returns, 2) / std(returns, 5)) + (1 - rank(delta(close, 1))))
35 = ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))
36 = rank(corr(open, volume, 10))
37 = -rank(ts_sum(open, 5)) * rank(returns)
38 = -rank(ts_rank(close, 10)) * rank(close / open)
39 = -rank(delta(close, 7) * (1 - rank(decay(volume / mean(volume, 20), 9))))
40 = -rank(std(high, 10)) * corr(high, volume, 10)
41 = (high * low) ** 0.5 - vwap
42 = rank(vwap - close) / rank(vwap + close)
43 = ts_rank(volume / mean(volume, 20), 20) * ts_rank(-delta(close, 7), 8)
44 = -corr(high, rank(volume), 5)
45 = -rank(ts_sum(delay(close, 5), 20) / 20) * corr(close, volume, 2) * rank(corr(ts_sum(close, 5), ts_sum(close, 20), 2))
46 = -rank(mean(close, 10))
47 = -rank(ts_max(high, 10) - close)
48 = -rank(sign(close - delay(close, 1)) + sign(delay(close, 1) - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3))) * ts_sum(volume, 5) / ts_sum(volume, 20)
49 = -rank(close - ts_max(close, 10))
50 = -ts_max(rank(corr(rank(volume), rank(vwap), 5)), 5)
51 = -rank(close - ts_min(close, 10))
52 = -delta(ts_min(low, 5), 5)
53 = -delta(close, 1)
54 = -(rank(low - close) * rank(corr(vwap, delay(vwap, 4), 18)))
55 = -corr(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)
56 = -rank((mean(volume, 10) - mean(volume, 20)) / mean(volume, 60))
57 = -rank(mean(close - ts_min(low, 9), 9))
58 = -ts_rank(decay(corr(vwap, volume, 4), 7), 6)
59 = -ts_rank(decay(rank(close - ts_max(close, 10)), 10), 8)
60 = -(2 * scale(rank((close - low - (high - close)) / (high - low))) - scale(rank(argmax(close, 10))))
61 = rank(vwap - ts_min(vwap, 16)) < rank(corr(vwap, mean(volume, 180), 18))
62 = -corr(vwap, ts_sum(mean(volume, 60), 20), 20)
63 = rank(decay(delta(close, 1), 2))
64 = rank(decay(corr(ts_rank(volume, 10), ts_rank(vwap, 10), 6), 4))
65 = rank(decay(corr(open, volume, 10), 7))
66 = -rank(decay(delta(vwap, 3), 10))
67 = rank(ts_max(close, 3))
68 = ts_rank(corr(rank(high), rank(volume), 5), 13)
69 = -rank(ts_max(delta(vwap, 2), 5))
70 = -rank(delta(close, 1))
71 = (rank(ts_max(close, 240)) - rank(ts_min(close, 240))) * rank(corr(close, volume, 180))
72 = rank(decay(corr(high, volume, 10), 10))
73 = -rank(decay(delta(vwap, 4), 3))
74 = rank(corr(close, ts_sum(mean(volume, 30), 37), 15)) < rank(corr(rank(vwap), rank(volume), 18))
75 = rank(corr(vwap, volume, 4))
76 = rank(decay(delta(close, 1), 20))
77 = rank(decay((high + low) / 2 + high - (vwap + high), 20))
78 = rank(corr(ts_sum(low, 5), ts_sum(mean(volume, 60), 20), 7))
79 = rank(delta(close, 2))
80 = -rank(sign(delta(open, 4)))
81 = -rank(log(vwap / ts_sum(vwap, 5)))
82 = -rank(decay(open, 10))
83 = -rank(high * low)
84 = ts_rank(vwap - ts_max(vwap, 15), 20)
85 = rank(corr(close, volume, 10))
86 = -rank(corr(close, open, 10))
87 = -rank(decay(delta(close, 2), 8))
88 = rank(decay(rank(close), 5)) - rank(decay(corr(vwap, returns, 5), 5))
89 = -rank(mean(close, 13))
90 = -rank(corr(rank(vwap), rank(volume), 5))
91 = -rank(close * volume)
92 = rank(decay(corr(rank(vwap), rank(volume), 4), 10))
93 = ts_rank(decay(corr(vwap, volume, 3), 5), 3)
94 = -rank(vwap - ts_min(vwap, 11)) * ts_rank(corr(ts_rank(vwap, 20), ts_rank(mean(volume, 30), 50), 12), 7)
95 = rank(open - ts_min(open, 12)) * ts_rank(corr(ts_sum(volume, 40), low, 12), 12)
96 = -rank(decay(corr(vwap, returns, 4), 7))
97 = rank(decay(delta(close, 1), 5))
98 = rank(decay(corr(vwap, mean(volume, 5), 3), 3))
99 = -rank(cov(rank(close), rank(volume), 5))
100 = -rank(corr(close, volume, 10))
101 = -rank(corr(close, open, 10))
"""
# fmt: on
