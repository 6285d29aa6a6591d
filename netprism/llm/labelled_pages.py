"""Hand-labelled pages: y="1" marks content, y="0" what is none inside it; what is not marked is none."""

_A = "The river rose by two metres in one night, and the old mill at the lower bridge was flooded again. People carried what they could to the upper floor, while the fire brigade pumped until morning."
_B = "Engineers say that the dam upstream held, but that its gates were opened too late. A report is to be ready in autumn; until then the level of the lake is kept lower than usual."
_C = "Nobody was hurt. The mayor thanked all who had helped, and promised that the warning system would be looked at."
_S = "It rained."

PAGES = [
    f"<html><head><title>River</title></head><body><div class='site-header'><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a></div><div class='content' y='1'><h1>Flood</h1><p>{_A}</p><p>{_B}</p><p>{_S}</p></div><div class='sidebar'><h3>More</h3><ul><li><a href='/1'>One more story</a></li><li><a href='/2'>Another story</a></li></ul></div><div id='footer'><p>All rights reserved. Contact us.</p></div></body></html>",
    f"<html><body><header><h1><a href='/'>The Paper</a></h1><nav><ul><li><a href='/a'>World</a></li><li><a href='/b'>Local</a></li></ul></nav></header><main y='1'><article><h2>After the flood</h2><p>{_B}</p><ul><li>Lower level</li><li>New gates, says the report</li></ul><p>{_C}</p></article></main><aside><p>Sign up for our letter and get news each morning.</p></aside><footer><p>Imprint</p></footer></body></html>",
    f"<body><div class='cookie-notice'><p>We use cookies to give you the best experience. By going on you agree to our terms and to the use of data.</p><button>Accept</button></div><div id='main'><div class='post' y='1'><h1>Mill</h1><p>{_C}</p><p>{_A}</p><blockquote><p>{_S}</p></blockquote></div><div class='comments'><h3>Comments</h3><div class='comment'><p>I was there and it was quite a sight, the water came up to the door and went no further, thank you for the report.</p></div><div class='comment'><p>Great story. I wonder who pays for all of this in the end.</p></div><form><label>Name</label><input><textarea>your words</textarea></form></div></div><div class='footer'>Copyright</div></body>",
    f"<body><table><tr><td class='menu'><a href='/1'>Start</a><br><a href='/2'>About</a></td><td y='1'><p>{_A}</p><p>{_B}</p></td></tr></table><div class='copyright'>2020 The Paper</div></body>",
    f"<body><div class='ad'>Buy two, get one. Only this week in all our shops.</div><section class='entry-content' y='1'><h1>Lake</h1><p>{_B}</p><div class='advert' y='0'>The best boats at the best price, see our new list.</div><p>{_A}</p><h2>Cost</h2><p>{_S}</p></section><div class='related'><h4>You may also like</h4><p><a href='/x'>The bridge that nobody wanted</a></p><p><a href='/y'>Ten lakes to see in summer</a></p></div></body>",
    f"<body><div class='breadcrumb'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div><article y='1'><header><h1>Gates</h1></header><p>{_A}</p><figure><figcaption>The mill on Monday</figcaption></figure><p>{_C}</p><aside y='0'><p>Read also: <a href='/z'>the long way to a new dam</a></p></aside><p>{_B}</p><footer y='0'><p>Share this on your page. Tags: water, dam</p></footer></article><section id='comments'><article class='comment'><p>{_S} And it will rain again, as it has each spring since I came here to live by the river.</p></article></section></body>",
    f"<body><div role='banner'><p>The Paper, since 1900</p></div><div role='navigation'><a href='/a'>A</a><a href='/b'>B</a></div><div role='main' y='1'><h1>Report</h1><p>{_B}</p><p>{_C}</p><pre>level 4.2 m</pre></div><div role='complementary'><p>Most read today: <a href='/q'>The gates of the dam</a></p></div><div role='contentinfo'><p>Imprint and terms of use</p></div></body>",
    f"<body><div class='modal newsletter'><p>Get our best stories by mail each week, free of charge and free of noise.</p><form><input><button>Join</button></form></div><div class='wrapper'><div class='text' y='1'><p>{_A}</p><p>{_S}</p><p>{_B}</p></div><div class='share social'><a href='/f'>Share</a><a href='/t'>Post</a></div></div><div class='bottom'><p><a href='/p'>Privacy</a> <a href='/c'>Contact</a></p></div></body>",
    f"<body><nav><a href='/'>Home</a></nav><div class='promo'><p>Our new book is out now, order it with free delivery until Sunday.</p></div><main y='1'><h1>Level</h1><p>{_C}</p><table><tr><th>Day</th><td>Level</td></tr><tr><td>Monday</td><td>4.2 m</td></tr></table><p>{_B}</p></main><div class='user-comments'><p>What a flood, I have seen none like it in all of my years at the mill by the bridge.</p></div><div class='popup notice'><p>You have read all of your free stories for this month.</p></div></body>",
    f"<body><div><p><a href='/l'>Log in</a></p></div><div y='1'><p>{_B}</p><p>{_A}</p><p>{_C}</p></div><div><p><a href='/1'>One</a> | <a href='/2'>Two</a></p></div></body>",
    f"<body><div id='header'>The Paper</div><div id='article-body' y='1'><p>{_S}</p><p>{_A}</p><ol><li>{_S}</li><li>The dam held, the gates did not.</li></ol></div><div id='disqus_thread'><p>Join the talk. Be the first to write what you think of this story.</p></div><div id='sidebar'><p>Weather: rain, more rain, and some sun at the end of the week.</p></div></body>",
]
